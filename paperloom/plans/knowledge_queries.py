"""Registered queries over knowledge units and facts (I, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import knowledge as K
from paperloom.operators import tables
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, listed, over, quoted, trimmed
from paperloom.sources import views as V
from paperloom.sources.scratch import shared_folder, written


def _joined(*cols: str) -> str:
    parts = ", ".join(f"{trimmed(c)}" for c in cols)
    return f"coalesce(list_aggregate(list_filter([{parts}], lambda x: x IS NOT NULL AND x <> ''), 'string_agg', chr(10)), '')"


def _loose(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '{rules.LOOSE}', '', 'g')"


_TIER = "CASE confidence_level WHEN 'GOLD' THEN 3 WHEN 'SILVER' THEN 2 ELSE 1 END"
_PRIORITY = "CASE extraction_method " + " ".join(f"WHEN '{m}' THEN {p}" for m, p in rules.METHOD_PRIORITY) + " ELSE 0 END"
_FAMILY = "CASE " + " ".join(f"WHEN knowledge_type IN ({listed(m)}) THEN '{f}'" for f, m in rules.FAMILIES) + " ELSE knowledge_type END"
_TAGS = "list_filter(list_transform(regexp_split_to_array(replace(replace(coalesce({x}, ''), '[', ''), ']', ''), '[,，;；|/\\n]'), lambda t: regexp_replace({trim}, '^[\"'']|[\"'']$', '', 'g')), lambda t: length(t) >= 2)"


def _tags(x: str) -> str:
    return _TAGS.format(x=x, trim=trimmed("t"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paper_rows(spark, sf_dir)
    i = F.col("paper_id")
    return p.select("paper_id", "title", F.concat(F.lit("problem "), i % 6).alias("research_problem"), F.when(i % 3 != 0, F.concat(F.lit("method "), i % 4)).alias("method_summary"),
                    F.lit(" ").alias("experiment_summary"), F.concat(F.lit("gain "), i).alias("key_contributions"), F.lit(None).cast("string").alias("limitations"), "keywords")


add_view(
    "profiles",
    ("paper_rows",),
    "SELECT paper_id, title, 'problem ' || (paper_id % 6) AS research_problem, CASE WHEN paper_id % 3 <> 0 THEN 'method ' || (paper_id % 4) END AS method_summary, ' ' AS experiment_summary, 'gain ' || paper_id AS key_contributions, keywords FROM paper_rows",
)


@query(
    over(
        f"""SELECT paper_id, knowledge_type, object_value FROM (SELECT paper_id, 'RESEARCH_PROBLEM' AS knowledge_type, research_problem AS object_value FROM profiles UNION ALL SELECT paper_id, 'METHOD', method_summary FROM profiles
  UNION ALL SELECT paper_id, 'EXPERIMENT_SETTING', experiment_summary FROM profiles UNION ALL SELECT paper_id, 'CONTRIBUTION', key_contributions FROM profiles
  UNION ALL SELECT paper_id, 'KEYWORD', unnest({_tags("keywords")}) FROM profiles) WHERE trim(object_value) <> ''""",
        "profiles",
    )
)
def i1_units_from_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.units_from_profiles(_profiles(spark, sf_dir)).select("paper_id", "knowledge_type", "object_value")


_SECTION = "CASE section_type WHEN 'METHOD' THEN 'METHOD' WHEN 'EXPERIMENT' THEN 'EXPERIMENT_SETTING' WHEN 'INTRODUCTION' THEN 'BACKGROUND' WHEN 'ABSTRACT' THEN 'BACKGROUND' ELSE 'CONCLUSION' END"


@query(over(f"SELECT chunk_id, {_SECTION} AS knowledge_type FROM chunks", "chunks"))
def i2_units_from_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).select("chunk_id", K.section_unit_type(F.col("section_type")).alias("knowledge_type"))


def _quoted_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.chunks(spark, sf_dir)
    quote = F.when(F.col("chunk_id") % 3 == 0, F.substring("content", 30, 40)).when(F.col("chunk_id") % 3 == 1, "not in the text at all").otherwise("")
    return c.select(F.col("chunk_id").alias("unit_id"), "paper_id", "section_type", quote.alias("quote"))


@query(
    over(
        f"""SELECT u.unit_id, coalesce(m.chunk_id, -1) AS chunk_id, CASE WHEN m.chunk_id IS NULL THEN 'BRONZE' ELSE 'SILVER' END AS tier FROM (SELECT chunk_id AS unit_id, paper_id, section_type,
  {_loose("CASE chunk_id % 3 WHEN 0 THEN substr(content, 30, 40) WHEN 1 THEN 'not in the text at all' ELSE '' END")} AS quote FROM chunks) u
  LEFT JOIN chunks m ON m.paper_id = u.paper_id AND m.section_type = u.section_type AND u.quote <> '' AND contains({_loose("m.content")}, u.quote)""",
        "chunks",
    )
)
def i4_match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.match_evidence(_quoted_units(spark, sf_dir), V.chunks(spark, sf_dir)).select("unit_id", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), "tier")


@query(over(f"SELECT min(unit_id) AS unit_id, paper_id, k AS normalized_key FROM (SELECT *, sha256({_joined(*K.KEY_COLUMNS)}) AS k FROM units) GROUP BY paper_id, k", "units"))
def i5_dedupe_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe_units(V.units(spark, sf_dir)).select("unit_id", "paper_id", "normalized_key")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of 400 documents as one paper, so that subjects meet; papers grow with the table."""
    return V.units(spark, sf_dir).withColumn("paper_id", F.floor(F.col("unit_id") / 400))


def _conflicts_sql(units: str) -> str:
    return f"""SELECT unit_id, g AS conflict_group, count(DISTINCT v) OVER (PARTITION BY p, g) > 1 AS has_conflict FROM (SELECT unit_id, unit_id // 400 AS p, sha256({_joined(*K.GROUP_COLUMNS)}) AS g, {_loose("object_value")} AS v
  FROM {units} WHERE knowledge_type IN ({listed(rules.CONFLICT_TYPES)}) AND extraction_method IN ('LLM', 'USER') AND verification_status <> 'REJECTED')"""


@query(over(_conflicts_sql("units"), "units"))
def i6_flag_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.flag_conflicts(_claims(spark, sf_dir)).select("unit_id", "conflict_group", "has_conflict")


@query(f"SELECT doc_id, unnest(list_distinct({_tags('text')})) AS tag FROM documents")
def i7_split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.explode(K.split_tags(F.col("text"))).alias("tag"))


_GROUPS = "CASE WHEN knowledge_type IN ('RESEARCH_DOMAIN', 'KEYWORD') THEN 'domains' WHEN knowledge_type IN ('RESEARCH_TASK', 'RESEARCH_PROBLEM') THEN 'tasks' WHEN knowledge_type IN ('METHOD', 'MODEL_COMPONENT') THEN 'methods' WHEN knowledge_type = 'DATASET' THEN 'datasets' WHEN knowledge_type = 'METRIC' THEN 'metrics' END"


def _catalog_sql(units: str) -> str:
    return f"""SELECT c.paper_id, c.units, c.verified, coalesce(t.methods, '') AS methods, coalesce(t.domains, '') AS domains, md5(c.txt) AS catalog_text, CASE WHEN coalesce(t.methods, '') <> '' THEN 'COMPLETED' ELSE 'PARTIAL' END AS status FROM (SELECT paper_id, string_agg(concat_ws(' ', knowledge_type, subject_text, predicate_text, object_value), chr(10) ORDER BY unit_id) AS txt, count(*) AS units, count(*) FILTER (WHERE verification_status IN ('CONFIRMED', 'CORRECTED')) AS verified FROM {units} WHERE verification_status <> 'REJECTED' GROUP BY 1) c
  LEFT JOIN (SELECT paper_id, string_agg(tag, '; ' ORDER BY n) FILTER (WHERE g = 'methods') AS methods, string_agg(tag, '; ' ORDER BY n) FILTER (WHERE g = 'domains') AS domains FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id, g ORDER BY spot) AS n FROM (SELECT paper_id, g, substr(tag, 1, {rules.TOPIC_LABEL_CHARS}) AS tag, min((unit_id, pos)) AS spot FROM (
      SELECT paper_id, unit_id, {_GROUPS} AS g, unnest({_tags("object_value")}) AS tag, generate_subscripts({_tags("object_value")}, 1) AS pos FROM {units} WHERE verification_status <> 'REJECTED') WHERE g IS NOT NULL GROUP BY 1, 2, 3))
    WHERE n <= CASE g WHEN 'methods' THEN 16 ELSE 12 END GROUP BY 1) t USING (paper_id)"""


@query(over(_catalog_sql("units"), "units"))
def i8_build_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_catalog(K.build_catalog(V.units(spark, sf_dir)))


def _told_catalog(out: DataFrame) -> DataFrame:
    return out.select("paper_id", "units", "verified", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("domains", F.lit("")).alias("domains"), F.md5("catalog_text").alias("catalog_text"), "status")


@query(
    over(
        f"""SELECT knowledge_type, label, papers, units FROM (SELECT knowledge_type, k, arg_min(label, unit_id) AS label, count(DISTINCT paper_id) AS papers, count(*) AS units FROM (
  SELECT *, {_loose("label")} AS k FROM (SELECT *, CASE WHEN length({trimmed("object_value")}) BETWEEN 2 AND 100 THEN {trimmed("object_value")} WHEN extraction_method IN ('LLM', 'USER') AND length({trimmed("subject_text")}) BETWEEN 2 AND 100 THEN {trimmed("subject_text")} END AS label
    FROM units WHERE verification_status <> 'REJECTED' AND knowledge_type IN ({listed(rules.TOPIC_TYPES)})) WHERE label IS NOT NULL) GROUP BY 1, 2)
  ORDER BY units DESC, label, knowledge_type LIMIT 50""",
        "units",
    )
)
def i9_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.topics(V.units(spark, sf_dir), None, 50)


@query(
    over(
        """SELECT unit_id, CASE action WHEN 'CONFIRM' THEN 'CONFIRMED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'CORRECTED' END AS status, CASE action WHEN 'REJECT' THEN 'BRONZE' ELSE 'GOLD' END AS tier, object_value
  FROM (SELECT unit_id, arg_max(action, (ts, event_id)) AS action, arg_max(object_value, (ts, event_id)) FILTER (WHERE object_value IS NOT NULL) AS object_value FROM feedback GROUP BY 1)""",
        "feedback",
    )
)
def i10_apply_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.apply_feedback(V.feedback(spark, sf_dir))


@query(
    over(
        """SELECT event_id, unit_id, action, last_value(object_value IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  last_value(object_value IGNORE NULLS) OVER (PARTITION BY unit_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM feedback""",
        "feedback",
    )
)
def i10_feedback_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.feedback_audit(V.feedback(spark, sf_dir))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback that corrects several fields; some corrections name no value and do not count."""
    i = F.col("event_id")
    correct = F.col("action") == "CORRECT"
    return V.feedback(spark, sf_dir).withColumns(
        {
            "object_value": F.when(correct & (i % 7 != 0), F.concat(F.lit(" Value "), i % 11, F.lit("; Way "), i % 4)),
            "subject_text": F.when(correct & (i % 2 == 0), F.concat(F.lit("Subject "), i % 6)).when(correct, " "),
            "predicate_text": F.when(correct & (i % 3 == 0), "uses"),
            "value_unit": F.when(correct & (i % 5 == 0), "ms"),
            "applicable_condition": F.lit(None).cast("string"),
        }
    )


add_view(
    "corrections",
    ("feedback",),
    """SELECT * FROM (SELECT event_id, unit_id, action, ts, CASE WHEN action = 'CORRECT' AND event_id % 7 <> 0 THEN 'Value ' || (event_id % 11) || '; Way ' || (event_id % 4) END AS object_value, CASE WHEN action = 'CORRECT' AND event_id % 2 = 0 THEN 'Subject ' || (event_id % 6) END AS subject_text,
  CASE WHEN action = 'CORRECT' AND event_id % 3 = 0 THEN 'uses' END AS predicate_text, CASE WHEN action = 'CORRECT' AND event_id % 5 = 0 THEN 'ms' END AS value_unit FROM feedback) WHERE action <> 'CORRECT' OR object_value IS NOT NULL""",
)
_LAST = lambda c: f"arg_max({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"
add_view(
    "units_after",
    ("units", "corrections"),
    f"""SELECT u.unit_id, u.paper_id, u.knowledge_type, coalesce(l.subject_text, u.subject_text) AS subject_text, coalesce(l.predicate_text, u.predicate_text) AS predicate_text, coalesce(l.object_value, u.object_value) AS object_value, l.value_unit,
  CASE action WHEN 'CONFIRM' THEN 'CONFIRMED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'CORRECT' THEN 'CORRECTED' ELSE verification_status END AS verification_status, CASE WHEN action = 'REJECT' THEN 'BRONZE' WHEN action IS NOT NULL THEN 'GOLD' ELSE confidence_level END AS confidence_level,
  CASE WHEN corrected THEN 'USER' ELSE extraction_method END AS extraction_method FROM units u LEFT JOIN (SELECT unit_id, arg_max(action, (ts, event_id)) AS action, bool_or(action = 'CORRECT') AS corrected, {_LAST("subject_text")}, {_LAST("predicate_text")}, {_LAST("object_value")}, {_LAST("value_unit")} FROM corrections GROUP BY 1) l USING (unit_id)""",
)


@query(
    over(
        f"SELECT unit_id, subject_text, predicate_text, md5(object_value) AS object_value, value_unit, verification_status, confidence_level, extraction_method, sha256({_joined(*K.KEY_COLUMNS)}) AS normalized_key, sha256({_joined(*K.GROUP_COLUMNS)}) AS conflict_group FROM units_after",
        "units_after",
    )
)
def i10_correct_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.corrected_units(V.units(spark, sf_dir), _corrections(spark, sf_dir))
    return out.select("unit_id", "subject_text", "predicate_text", F.md5("object_value").alias("object_value"), "value_unit", "verification_status", "confidence_level", "extraction_method", "normalized_key", "conflict_group")


def _field_sql(c: str, first: str) -> str:
    told = lambda upto: f"coalesce(last_value(c.{c} IGNORE NULLS) OVER (PARTITION BY c.unit_id ORDER BY c.ts, c.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {upto}), {first})"
    return f"SELECT c.event_id, c.unit_id, c.action, '{c}' AS field, {told('1 PRECEDING')} AS before, {told('CURRENT ROW')} AS after FROM corrections c JOIN units u USING (unit_id)"


def _state_sql(c: str, value: str) -> str:
    return f"SELECT c.event_id, c.unit_id, c.action, '{c}' AS field, coalesce(lag({value}) OVER (PARTITION BY c.unit_id ORDER BY c.ts, c.event_id), u.{c}) AS before, {value} AS after FROM corrections c JOIN units u USING (unit_id)"


@query(
    over(
        "SELECT event_id, unit_id, action, field, md5(before) AS before, md5(after) AS after FROM ("
        + " UNION ALL ".join(
            [
                _state_sql("verification_status", "CASE c.action WHEN 'CONFIRM' THEN 'CONFIRMED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'CORRECTED' END"),
                _state_sql("confidence_level", "CASE WHEN c.action = 'REJECT' THEN 'BRONZE' ELSE 'GOLD' END"),
                *[_field_sql(c, f"u.{c}") for c in ("subject_text", "predicate_text", "object_value")],
                _field_sql("value_unit", "NULL"),
            ]
        )
        + ") WHERE before IS DISTINCT FROM after",
        "units",
        "corrections",
    )
)
def i10_correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.correction_audit(V.units(spark, sf_dir), _corrections(spark, sf_dir))
    return out.withColumns({"before": F.md5("before"), "after": F.md5("after")})


@query(over(_catalog_sql("units_after"), "units_after"))
def i10_refresh_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalog with the papers of corrected units built again; it equals a full rebuild."""
    units = V.units(spark, sf_dir)
    return _told_catalog(K.refreshed(written(K.build_catalog(units)), units, _corrections(spark, sf_dir), K.build_catalog))


@query(over(_conflicts_sql("units_after"), "units_after"))
def i10_refresh_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _claims(spark, sf_dir)
    flagged = lambda rows: K.flag_conflicts(rows).select("paper_id", "unit_id", "conflict_group", "has_conflict")
    return K.refreshed(written(flagged(units)), units, _corrections(spark, sf_dir), flagged).select("unit_id", "conflict_group", "has_conflict")


@query(over("SELECT unit_id, paper_id, knowledge_type, section_title FROM units u LEFT JOIN (SELECT chunk_id AS unit_id, section_title FROM chunks) USING (unit_id) WHERE verification_status <> 'REJECTED'", "units", "chunks"))
def i11_list_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = V.chunks(spark, sf_dir).select(F.col("chunk_id").alias("unit_id"), "section_title")
    return K.list_units(V.units(spark, sf_dir), titles).select("unit_id", "paper_id", "knowledge_type", "section_title")


@query(
    over(
        """SELECT paper_id, (n - 1) // 3 AS batch, count(*) AS members, md5(substr(string_agg('Summary of ' || section_title || chr(10) || '- ' || section_type || chr(10) || coalesce(content, ''), chr(10) ORDER BY n), 1, 7000)) AS material
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) AS n FROM chunks) GROUP BY 1, 2""",
        "chunks",
    )
)
def i12_extraction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.chunks(spark, sf_dir).withColumn("section_id", F.col("chunk_id"))
    summaries = rows.select("paper_id", "section_id", F.concat(F.lit("Summary of "), "section_title").alias("summary"), F.concat(F.lit("- "), "section_type").alias("key_points"))
    return K.extraction_batches(summaries, rows.select("section_id", "chunk_index", F.coalesce("content", F.lit("")).alias("content"))).withColumn("material", F.md5("material"))


@query(over("SELECT p.paper_id, p.title, coalesce(c.status, 'NOT_BUILT') AS status FROM paper_rows p LEFT JOIN (SELECT DISTINCT paper_id, 'COMPLETED' AS status FROM units WHERE confidence_level = 'GOLD') c USING (paper_id)", "paper_rows", "units"))
def i13_catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = V.units(spark, sf_dir).where("confidence_level = 'GOLD'").select("paper_id", F.lit("COMPLETED").alias("status")).distinct()
    return K.catalog_listing(V.paper_rows(spark, sf_dir), built)


_F12 = ("METHOD", "MODEL_COMPONENT", "DATASET", "RESULT", "COMPARISON", "LIMITATION")


@query(
    over(
        f"""SELECT unit_id, paper_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY lead DESC, {_TIER} DESC, {_PRIORITY} DESC, unit_id) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, {_FAMILY} ORDER BY {_TIER} DESC, {_PRIORITY} DESC, unit_id) = 1 AS lead FROM (SELECT * EXCLUDE (paper_id), unit_id // 400 AS paper_id FROM units) WHERE verification_status <> 'REJECTED' AND knowledge_type IN ({listed(_F12)}))) WHERE pos <= 5""",
        "units",
    )
)
def f12_select_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.select_units(_claims(spark, sf_dir), _F12, 5).withColumn("pos", F.col("pos").cast("long"))


_EXPORT = over("SELECT unit_id, paper_id, to_json({'subject': subject_text, 'object': object_value}) AS target FROM units WHERE verification_status <> 'REJECTED' AND evidence_text IS NOT NULL AND confidence_level IN ('GOLD', 'SILVER')", "units")


@query(_EXPORT)
def a17_export_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.units(spark, sf_dir).where("verification_status <> 'REJECTED' AND evidence_text IS NOT NULL").where(K.tier_rank(F.col("confidence_level")) >= 2)
    return rows.select("unit_id", "paper_id", F.to_json(F.struct(F.col("subject_text").alias("subject"), F.col("object_value").alias("object"))).alias("target"))


@query(_EXPORT)
def a17_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as JSON lines in order of paper and unit, read back."""
    path = f"{shared_folder(spark)}/dataset"
    rows = a17_export_dataset(spark, sf_dir)
    tables.export_json(rows, path, ["paper_id", "unit_id"])
    return spark.read.schema(rows.schema).json(path)


# --- facts

_MINED = " UNION ALL ".join(
    f"SELECT paper_id, chunk_id, section_type, 'HYPERPARAMETER' AS fact_type, '{k}' AS fact_key, unnest(regexp_extract_all(content, '{p}', 1)) AS fact_value, {rules.FACT_CONFIDENCE} AS confidence FROM chunks WHERE NOT is_reference AND NOT is_noise AND section_type IN ('METHOD', 'EXPERIMENT')"
    for k, p in rules.PARAMETERS
)
add_view("mined", ("chunks",), _MINED)
add_view("pooled", ("mined",), "SELECT * EXCLUDE (paper_id), paper_id // 12 AS paper_id, chunk_id * 10 AS fact_id FROM mined")
add_view(
    "merged",
    ("pooled",),
    "SELECT paper_id, logical, value, min(chunk_id) AS chunk_id, max(confidence) AS confidence, count(*) AS support, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS sources FROM (SELECT *, lower(fact_type) || '|' || lower(fact_key) AS logical, lower(fact_value) AS value FROM pooled) GROUP BY 1, 2, 3",
)
add_view("conflicted", ("merged",), "SELECT *, CASE WHEN count(DISTINCT value) OVER (PARTITION BY paper_id, logical) > 1 THEN 'conflict-' || substr(sha256(logical), 1, 16) END AS conflict_group FROM merged")


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mine_hyperparameters(V.chunks(spark, sf_dir)).withColumn("paper_id", F.floor(F.col("paper_id") / 12))


_UNITS = "CASE fact_key " + " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in rules.PARAMETER_UNITS) + " ELSE '-' END"
add_view(
    "matched",
    ("chunks",),
    " UNION ALL ".join(
        f"""SELECT chunk_id, content, '{k}' AS fact_key, unnest(vs) AS fact_value, unnest(ws) AS whole, unnest(list_transform(range(1, len(vs) + 1), lambda i: coalesce(list_sum(list_transform(bs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0))) AS start
  FROM (SELECT chunk_id, content, regexp_extract_all(content, '{p}', 1) AS vs, regexp_extract_all(content, '{p}', 0) AS ws, regexp_split_to_array(content, '{p}') AS bs FROM chunks WHERE NOT is_reference AND NOT is_noise AND section_type IN ('METHOD', 'EXPERIMENT'))"""
        for k, p in rules.PARAMETERS
    ),
)


@query(
    over(
        f"SELECT chunk_id, fact_key, fact_value, {_UNITS} AS unit, substr(content, CAST(greatest(start - {rules.EXCERPT_BEFORE}, 0) + 1 AS BIGINT), CAST(start - greatest(start - {rules.EXCERPT_BEFORE}, 0) + length(whole) + {rules.EXCERPT_AFTER} AS BIGINT)) AS excerpt FROM matched",
        "matched",
    )
)
def j1_mine_hyperparameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.mine_hyperparameters(V.chunks(spark, sf_dir)).select("chunk_id", "fact_key", "fact_value", F.coalesce("unit", F.lit("-")).alias("unit"), "excerpt")


@query(over("SELECT * FROM merged", "merged"))
def j7_merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.merge_facts(_pooled(spark, sf_dir)).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query(over("SELECT paper_id, logical, value, conflict_group FROM conflicted", "conflicted"))
def j8_fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fact_conflicts(K.merge_facts(_pooled(spark, sf_dir))).select("paper_id", "logical", "value", "conflict_group")


@query(over("SELECT paper_id, count(*) AS facts, count(conflict_group) AS conflicting, count(DISTINCT logical) AS keys FROM conflicted GROUP BY 1", "conflicted"))
def j9_fact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.fact_conflicts(K.merge_facts(_pooled(spark, sf_dir)))
    return rows.groupBy("paper_id").agg(F.count("*").alias("facts"), F.count("conflict_group").alias("conflicting"), F.count_distinct("logical").alias("keys"))


_STATUSES = ("EXTRACTED", "CROSS_CHECKED", "USER_CONFIRMED", "MODEL_INFERRED", "REJECTED")
_TYPES = tuple(t for _, members in rules.CRITICAL_GROUPS for t in members)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all types and statuses, made of units."""
    u = V.units(spark, sf_dir)
    i = F.col("unit_id")
    return u.select(
        i.alias("fact_id"), F.floor(i / 60).alias("paper_id"), V.pick(_TYPES, i % len(_TYPES)).alias("fact_type"), F.concat(F.lit("k"), i % 3).alias("fact_key"), F.col("object_value").alias("fact_value"),
        V.pick(_STATUSES, i % 5).alias("verification_status"), (i % 10 / 10.0).alias("confidence"), F.when(i % 17 == 0, "conflict-x").alias("conflict_group"),
        F.when(i % 4 != 0, "RAW_CHUNK").alias("source_kind"), (i % 30).alias("page_number"), "evidence_text",
    )


def _pick_sql(values, index: str) -> str:
    return "[" + listed(values) + f"][{index} + 1]"


add_view(
    "facts",
    ("units",),
    f"""SELECT unit_id AS fact_id, unit_id // 60 AS paper_id, {_pick_sql(_TYPES, f"unit_id % {len(_TYPES)}")} AS fact_type, 'k' || (unit_id % 3) AS fact_key, object_value AS fact_value, {_pick_sql(_STATUSES, "unit_id % 5")} AS verification_status,
  unit_id % 10 / 10.0 AS confidence, CASE WHEN unit_id % 17 = 0 THEN 'conflict-x' END AS conflict_group, CASE WHEN unit_id % 4 <> 0 THEN 'RAW_CHUNK' END AS source_kind, unit_id % 30 AS page_number, evidence_text FROM units""",
)
add_view(
    "classed",
    ("facts",),
    "SELECT *, CASE WHEN conflict_group IS NOT NULL THEN 'conflict' WHEN verification_status = 'MODEL_INFERRED' THEN 'inferred' WHEN verification_status IN ('USER_CONFIRMED', 'CROSS_CHECKED') OR (verification_status = 'EXTRACTED' AND confidence >= 0.7) THEN 'trusted' ELSE 'review' END AS class FROM facts",
)
_CRITICAL = "CASE " + " ".join(f"WHEN fact_type IN ({listed(t)}) THEN '{n}'" for n, t in rules.CRITICAL_GROUPS) + " END"
add_view(
    "covered",
    ("classed",),
    f"""SELECT paper_id, round((8 - len(missing)) / 8.0, 4) AS coverage, coalesce(list_aggregate(missing, 'string_agg', ','), '') AS missing, conflicts FROM (SELECT paper_id, conflicts, list_sort(list_filter([{listed(n for n, _ in rules.CRITICAL_GROUPS)}], lambda x: NOT list_contains(have, x))) AS missing
  FROM (SELECT paper_id, coalesce(list(DISTINCT {_CRITICAL}) FILTER (WHERE class = 'trusted'), []) AS have, count(DISTINCT conflict_group) AS conflicts FROM classed GROUP BY 1))""",
)


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).withColumn("class", K.fact_class(F.col("verification_status"), F.col("confidence"), F.col("conflict_group")))


@query(over("SELECT paper_id, class, count(*) AS facts FROM classed GROUP BY 1, 2", "classed"))
def j10_spec_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).groupBy("paper_id", "class").agg(F.count("*").alias("facts"))


@query(
    over(
        "SELECT paper_id, conflict_group, arg_min(fact_key, (page_number, fact_id)) AS fact_key, count(*) AS n, md5(string_agg(concat_ws('|', fact_id, fact_value, verification_status), chr(10) ORDER BY page_number, fact_id)) AS candidates FROM facts WHERE conflict_group IS NOT NULL GROUP BY 1, 2",
        "facts",
    )
)
def j10_conflict_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.conflict_candidates(_facts(spark, sf_dir))
    lines = F.transform("candidates", lambda c: F.concat_ws("|", c["fact_id"].cast("string"), c["fact_value"], c["verification_status"]))
    return out.select("paper_id", "conflict_group", "fact_key", F.size("candidates").cast("long").alias("n"), F.md5(F.array_join(lines, "\n")).alias("candidates"))


@query(over("SELECT paper_id, coverage, missing FROM covered", "covered"))
def j11_critical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.critical_coverage(_classed(spark, sf_dir))


@query(over("SELECT paper_id, round(avg(CASE WHEN source_kind IS NOT NULL AND page_number IS NOT NULL AND evidence_text IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM facts GROUP BY 1", "facts"))
def j12_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.provenance_coverage(_facts(spark, sf_dir))


_NOTES = {"always": "true", "conflicts": "conflicts > 0"}
_TEXTS = ", ".join(f"CASE WHEN {_NOTES.get(k, f'list_contains(string_split(missing, chr(44)), {quoted(k)})')} THEN {quoted(t)} END" for k, t in rules.SAFE_DEFAULTS)


@query(over(f"SELECT paper_id, CASE WHEN coverage = 0 THEN 'NOT_READY' WHEN conflicts > 0 THEN 'NEEDS_REVIEW' WHEN missing <> '' THEN 'PARTIAL' ELSE 'READY' END AS status, concat_ws(chr(10), {_TEXTS}) AS notes FROM covered", "covered"))
def j13_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classed(spark, sf_dir)
    conflicts = rows.groupBy("paper_id").agg(F.count_distinct("conflict_group").alias("conflicts"))
    both = K.critical_coverage(rows).join(conflicts, "paper_id")
    return both.select("paper_id", K.readiness(F.col("coverage"), F.col("conflicts"), F.col("missing")).alias("status"), F.array_join(K.safe_defaults(F.col("missing"), F.col("conflicts")), "\n").alias("notes"))


@query(over("SELECT paper_id, sha256('spec-v1' || chr(10) || string_agg(concat_ws('|', fact_id, fact_value, verification_status), chr(10) ORDER BY fact_id)) AS revision FROM facts GROUP BY 1", "facts"))
def j14_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spec_revision(_facts(spark, sf_dir), "spec-v1")
