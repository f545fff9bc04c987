"""Registered queries over questions, ideas, drafts, model output and run quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import drafts as R
from paperloom.plans import knowledge_queries, search_queries, table_queries
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, over, trimmed
from paperloom.sources import views as V


@query(f"SELECT item_id AS question_id, 0 AS pos, {trimmed('text')} AS variant FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, 1, {trimmed('concat(chr(81), chr(32), text)')} FROM benchmark WHERE item_id % 3 = 1 UNION ALL SELECT item_id, 0, text FROM benchmark WHERE item_id % 3 = 0")
def e6_query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("item_id"), F.col("text")
    b = V.table(spark, sf_dir, "benchmark").select(
        i.alias("question_id"), t.alias("question"), F.when(i % 3 != 0, t).alias("a"), F.when(i % 3 == 1, F.concat(F.lit("Q "), t)).otherwise("  ").alias("b"), F.when(i % 3 != 0, F.concat(F.lit(" "), t)).alias("c")
    )
    return R.query_variants(b, ("a", "b", "c"))


@query("SELECT doc_id, len(list_filter(['the', 'of', 'de', 'und'], lambda x: contains(lower(text), x))) AS matches FROM documents")
def e15_term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(x) for x in ("the", " Of ", "de", "x", "und", "the")])
    return V.table(spark, sf_dir, "documents").select("doc_id", R.term_matches(F.col("text"), terms).alias("matches"))


@query(
    over(
        "SELECT question_id, chunk_id FROM (SELECT *, bool_or(f) OVER (PARTITION BY question_id) AS found FROM (SELECT question_id, chunk_id, section_type IN ('METHOD', 'EXPERIMENT') AS f FROM topped JOIN chunks USING (chunk_id))) WHERE f OR NOT found",
        "topped",
        "chunks",
    )
)
def e16_filter_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_queries.c6_bm25_topk(spark, sf_dir).join(V.chunks(spark, sf_dir).select("chunk_id", "section_type"), "chunk_id")
    return R.filter_by_section(rows, ("Methods", "Experiment")).select("question_id", "chunk_id")


@query(f"SELECT conv_id, turn, NOT regexp_matches(q, '{rules.EXPLICIT_PAPER}') AND (regexp_matches(q, '{rules.NEEDS_CONTEXT}') OR (length(q) <= 12 AND NOT regexp_matches(q, '[A-Za-z]{{3,}}'))) AS needs FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN turn || '?' ELSE text END WHEN 1 THEN '继续 ' || text ELSE 'paper ' || conv_id || ' 它' END AS q FROM conversations)")
def g4_needs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    q = F.when(k == 0, F.when(F.col("conv_id") % 2 == 0, F.concat("turn", F.lit("?"))).otherwise(F.col("text"))).when(k == 1, F.concat(F.lit("继续 "), "text")).otherwise(F.concat(F.lit("paper "), "conv_id", F.lit(" 它")))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", R.needs_history(q).alias("needs"))


@query("SELECT session_id, string_agg(p, ',' ORDER BY t, s) AS paper_ids FROM (SELECT session_id, p, min(t * 2 + s) // 2 AS t, min(t * 2 + s) % 2 AS s FROM (SELECT conv_id AS session_id, turn AS t, 0 AS s, turn % 4 + 1 AS p FROM conversations UNION ALL SELECT conv_id, turn, 1, conv_id % 3 + 1 FROM conversations) GROUP BY 1, 2) GROUP BY 1")
def g8_session_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.concat(F.lit('[{"paperId": '), F.col("turn") % 4 + 1, F.lit(', "x": {"deep": [{"paperId":"'), F.col("conv_id") % 3 + 1, F.lit('"}, {"paperId": 0}]}}]'))
    m = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_id"), json.alias("sources_json"))
    return R.session_papers(m)


#: A text as one line of words, which JSON takes as it is.
_CLEAN = r"[^\p{L}\p{N}]+"
_WORDS = f"trim(regexp_replace(text, '{_CLEAN}', ' ', 'g'))"


def _words() -> Column:
    return F.trim(F.regexp_replace("text", _CLEAN, " "))


@query(f"SELECT doc_id, md5(coalesce(CASE doc_id % 4 WHEN 0 THEN {_WORDS} || '；' || doc_id WHEN 1 THEN {_WORDS} WHEN 2 THEN {_WORDS} || ' as it is' END, '~')) AS value FROM documents")
def h5_flex_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit('["'), _words(), F.lit('", null, '), i, F.lit("]"))).when(i % 4 == 1, F.concat(F.lit('"'), _words(), F.lit('"'))).when(i % 4 == 2, F.concat(_words(), F.lit(" as it is"))).otherwise("[]")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(R.flex_string(raw), F.lit("~"))).alias("value"))


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN {_WORDS} ELSE substr('no json, ' || {_WORDS} || ' only, and it is long', 1, 30) END) AS title FROM documents")
def h6_salvage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('Sure:\n```json\n{"title": "'), _words(), F.lit('", "n": {"a": 1}}\n``` done'))
    raw = F.when(F.col("doc_id") % 2 == 0, good).otherwise(F.concat(F.lit("no json, "), _words(), F.lit(" only, and it is long")))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(R.salvage_json(raw, "title")).alias("title"))


@query(
    over(
        f"""SELECT paper_id, section_type, md5(substr(string_agg({trimmed("content")}, chr(10) || chr(10) ORDER BY chunk_index), 1, 8000)) AS digest, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids, CAST(sum(greatest(1, CAST(ceil(length(content) / 4.0) AS BIGINT))) AS BIGINT) AS tokens
  FROM usable WHERE length({trimmed("content")}) >= 20 GROUP BY 1, 2""",
        "usable",
    )
)
def h3_section_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.section_material(V.chunks(spark, sf_dir))
    return out.select("paper_id", "section_type", F.md5("material").alias("digest"), "chunk_ids", "tokens")


@query(over("SELECT paper_id, md5(substr(string_agg('[' || section_title || ']' || chr(10) || content || chr(10) || chr(10), '' ORDER BY chunk_index), 1, 12000)) AS digest FROM usable GROUP BY 1", "usable"))
def h4_profile_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile_material(V.chunks(spark, sf_dir)).select("paper_id", F.md5("material").alias("digest"))


_B20 = """SELECT doc_id AS asset_id, ['FIGURE', 'TABLE', 'EQUATION', 'PAGE_IMAGE'][doc_id % 4 + 1] AS asset_type, CASE WHEN doc_id % 3 = 0 THEN 'Overall Network architecture' ELSE 'Parameter settings where ' || source END AS caption,
  doc_id % 10 / 10.0 AS confidence, CASE WHEN doc_id % 7 = 0 THEN 'REJECTED' ELSE 'EXTRACTED' END AS verification_status, CASE WHEN doc_id % 5 = 0 THEN 'v1' END AS analysis_version FROM documents"""


@query(
    f"""SELECT asset_id, asset_type FROM ({_B20}) WHERE verification_status <> 'REJECTED' AND coalesce(analysis_version, '') <> 'v1' AND CASE asset_type WHEN 'FIGURE' THEN regexp_matches(lower(caption), '{rules.VISION_FIGURE}')
  WHEN 'TABLE' THEN confidence < 0.7 AND regexp_matches(lower(caption), '{rules.VISION_TABLE}') WHEN 'EQUATION' THEN confidence < 0.7 AND regexp_matches(lower(caption), '{rules.VISION_EQUATION}') ELSE false END"""
)
def b20_vision_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    caption = F.when(i % 3 == 0, "Overall Network architecture").otherwise(F.concat(F.lit("Parameter settings where "), "source"))
    a = V.table(spark, sf_dir, "documents").select(
        i.alias("asset_id"), V.pick(("FIGURE", "TABLE", "EQUATION", "PAGE_IMAGE"), i % 4).alias("asset_type"), caption.alias("caption"), F.lit("").alias("raw_text"), (i % 10 / 10.0).alias("confidence"),
        F.when(i % 7 == 0, "REJECTED").otherwise("EXTRACTED").alias("verification_status"), F.when(i % 5 == 0, "v1").alias("analysis_version"),
    )
    return R.vision_eligible(a, "v1").select("asset_id", "asset_type")


def _points_sql(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper({x}), '{p}') THEN {n}" for n, p in table) + " ELSE 1 END"


@query(over(f"SELECT fact_id, paper_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY {_points_sql('fact_type', rules.FACT_POINTS)} DESC, fact_id) AS pos FROM classed WHERE class = 'trusted') WHERE pos <= 4", "classed"))
def j16_top_fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knowledge_queries._classed(spark, sf_dir).where("class = 'trusted'")
    return R.top_by_points(rows, R.points(F.col("fact_type"), rules.FACT_POINTS), "fact_id", 4).select("fact_id", "paper_id", "pos")


@query(over(f"SELECT chunk_id, paper_id, points, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY points DESC, chunk_index) AS pos FROM (SELECT *, {_points_sql(chr(115) + 'ection_type', rules.SECTION_POINTS)} AS points FROM chunks)) WHERE pos <= 4", "chunks"))
def j18_top_section_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_by_points(V.chunks(spark, sf_dir), R.points(F.col("section_type"), rules.SECTION_POINTS), "chunk_index", 4).select("chunk_id", "paper_id", "points", "pos")


add_view(
    "ideas",
    (),
    "SELECT doc_id AS idea_id, text AS title, 'Tag' || (doc_id % 6) || ',' || lang AS tags, ['draft', 'idea', 'todo', 'implemented', 'manual'][doc_id % 5 + 1] AS save_type, CASE WHEN doc_id % 2 = 0 THEN 'rag_chat' ELSE 'own' END AS source_type, CASE WHEN doc_id % 3 > 0 THEN doc_id % 40 END AS session_id, doc_id AS update_time FROM documents",
)


def _ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return V.table(spark, sf_dir, "documents").select(
        i.alias("idea_id"), F.col("text").alias("title"), F.concat(F.lit("Tag"), i % 6, F.lit(","), "lang").alias("tags"), V.pick((*rules.SAVE_TYPES, "manual"), i % 5).alias("save_type"),
        F.when(i % 2 == 0, "rag_chat").otherwise("own").alias("source_type"), F.when(i % 3 > 0, i % 40).alias("session_id"), i.alias("update_time"),
    )


@query(over("SELECT idea_id, md5(title) AS title FROM ideas WHERE (contains(lower(title), 'tag3') OR contains(lower(tags), 'tag3')) AND save_type = 'idea'", "ideas"))
def k1_search_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_ideas(_ideas(spark, sf_dir), "TAG3", save_type="idea").select("idea_id", F.md5("title").alias("title"))


@query(over("SELECT count(*) FILTER (WHERE save_type = 'draft') AS draft, count(*) FILTER (WHERE save_type = 'idea') AS idea, count(*) FILTER (WHERE save_type = 'todo') AS todo, count(*) FILTER (WHERE save_type = 'implemented') AS implemented, count(*) FILTER (WHERE save_type <> 'manual') AS total FROM ideas", "ideas"))
def k2_idea_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.idea_counts(_ideas(spark, sf_dir))


@query(over("SELECT session_id, min(idea_id) AS idea_id FROM ideas WHERE source_type = 'rag_chat' AND session_id IS NOT NULL GROUP BY 1", "ideas"))
def k3_dedupe_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_ideas(_ideas(spark, sf_dir))


_PLACE = rules.MISSING_SOURCE


@query(over(f"SELECT project_id, md5(replace(regexp_replace(content, '\\[P[56]\\]', '{_PLACE}', 'g'), '[P999]', '{_PLACE}')) AS digest FROM drafts", "drafts"))
def k6_normalize_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_queries._drafts(spark, sf_dir)
    allowed = docs.select("project_id", F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")).alias("ids"))
    return R.normalize_citations(docs, allowed, "project_id").select("project_id", F.md5("content").alias("digest"))


@query(over("SELECT project_id, count(*) AS requested, count(*) FILTER (WHERE p.paper_id IS NULL) AS missing, count(*) > 20 AS refused FROM (SELECT doc_id AS project_id, unnest(range(doc_id // 6, doc_id // 6 + doc_id % 25 + 1)) AS paper_id FROM documents) r LEFT JOIN paper_rows p USING (paper_id) GROUP BY 1", "paper_rows"))
def k13_validate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.floor(F.col("doc_id") / 6)
    p = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.sequence(low, low + F.col("doc_id") % 25).alias("paper_ids"))
    return R.validate_selection(p, V.paper_rows(spark, sf_dir))


@query("SELECT event_type AS stage, user_id % 3 AS variant, count(*) AS calls, CAST(sum(CASE WHEN event_id % 7 > 0 THEN event_id % 100 END) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_id % 7 = 0) AS unknown, count(*) FILTER (WHERE value > 20) AS ok, round(sum(value), 3) AS ms FROM events GROUP BY 1, 2")
def l4_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    calls = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("variant"), F.when(i % 7 > 0, i % 100).alias("tokens"), (F.col("value") > 20).alias("ok"), F.col("value").alias("ms"))
    return R.usage_rollup(calls, ("stage", "variant")).withColumn("ms", F.round("ms", 3))


@query(
    over(
        """SELECT question_id, round(avg(CASE WHEN paper_id % 2 = question_id % 2 THEN 1.0 ELSE 0.0 END), 6) AS purity, round(avg(CASE WHEN is_reference OR is_noise THEN 1.0 ELSE 0.0 END), 6) AS contamination, count(DISTINCT source_type) > 1 AS multi_granularity,
  round(avg(CASE WHEN route = 'lexical' THEN 1.0 ELSE 0.0 END), 6) AS strategy_accuracy, round(avg(coalesce(len(list_filter(terms, lambda t: contains(lower(content), t))) / len(terms), 0.0)), 6) AS keyword_coverage FROM (SELECT h.*, c.is_reference, c.is_noise, c.content, t.terms FROM hits h JOIN chunks c USING (chunk_id)
  LEFT JOIN (SELECT question_id, list(term) AS terms FROM hit_terms GROUP BY 1) t ON t.question_id = h.question_id) GROUP BY 1""",
        "hits",
        "chunks",
        "hit_terms",
    )
)
def l6_guard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = search_queries._hit_terms(spark, sf_dir).groupBy("question_id").agg(F.collect_set("term").alias("terms"))
    rows = search_queries._hits(spark, sf_dir).join(V.chunks(spark, sf_dir).drop("paper_id"), "chunk_id").join(terms, "question_id", "left")
    held = F.size(F.filter("terms", lambda t: F.lower("content").contains(t))) / F.size("terms")
    rows = rows.select(
        "question_id", "source_type", (F.col("paper_id") % 2 == F.col("question_id") % 2).alias("in_scope"), (F.col("is_reference") | F.col("is_noise")).alias("contaminated"),
        (F.col("route") == "lexical").alias("right_strategy"), F.coalesce(held, F.lit(0.0)).alias("keyword_share"),
    )
    return R.guard_metrics(rows, "question_id")
