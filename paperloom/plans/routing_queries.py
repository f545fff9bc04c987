"""Registered queries over question routes, structured evidence, fields of model output, ideas and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import drafts as R
from paperloom.operators import routing, structured, writing
from paperloom.plans import search_queries, table_queries
from paperloom.plans.catalog import query
from paperloom.plans.text_queries import trimmed
from paperloom.plans.views_sql import add_view, choice, listed, over, quoted
from paperloom.sources import views as V
from paperloom.sources.scratch import written

#: What the test questions ask beside their own text.
ASKS = ("which dataset and metric", "limitation of the model", "哪些论文有新颖的方向", "请全面介绍", "比较 method result", "解决什么问题", "novelty and rmse", "类似的")
_CLEAN = r"[^\p{L}\p{N} ]"


def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def _list(values) -> str:
    return f"CAST([{listed(values)}] AS VARCHAR[])"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = V.table(spark, sf_dir, "benchmark"), F.col("item_id")
    none = F.array().cast("array<bigint>")
    return b.select(i.alias("question_id"), F.concat(V.pick(ASKS, i % 8), F.lit(" "), "text").alias("question"), F.when(i % 3 == 0, none).when(i % 3 == 1, F.array(i + 1)).otherwise(F.array(i + 2, i + 1, i + 2)).alias("paper_ids"))


add_view("asked", (), f"SELECT item_id AS question_id, {choice(ASKS, 'item_id % 8')} || ' ' || text AS question, CASE item_id % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [item_id + 1] ELSE [item_id + 2, item_id + 1, item_id + 2] END AS paper_ids FROM benchmark")


def _routes_sql() -> str:
    flags = ", ".join(f"{_has('q', words)} AS is_{name}" for name, words, _, _ in (*rules.ROUTES, *rules.SOLE_ROUTES))
    sole = " ".join(f"WHEN is_{n} THEN {{{n}}}" for n, _, _, _ in rules.SOLE_ROUTES)
    pick = lambda at, other: "CASE " + sole.format(**{r[0]: _list(r[at]) for r in rules.SOLE_ROUTES}) + f" ELSE {other} END"
    every = lambda at: "flatten([" + ", ".join(f"CASE WHEN is_{r[0]} THEN {_list(r[at])} ELSE {_list(())} END" for r in rules.ROUTES) + "])"
    intent = "CASE " + sole.format(**{r[0]: quoted(r[0]) for r in rules.SOLE_ROUTES}) + " " + " ".join(f"WHEN is_{r[0]} THEN {quoted(r[0])}" for r in reversed(rules.ROUTES)) + " ELSE 'OVERVIEW' END"
    return f"""SELECT question_id, question, paper_ids, scope, types, sections, CASE WHEN broad THEN 'DISCOVERY' WHEN fuzzy THEN 'FUZZY' WHEN whole THEN 'CROSS_SECTION' ELSE intent END AS intent,
  CASE WHEN broad OR fuzzy THEN 'PAPER_CATALOG' WHEN whole THEN 'PROFILE_AND_SECTION' WHEN len(types) = 0 OR intent = 'RESEARCH_TASK' THEN 'PAPER_PROFILE' ELSE 'KNOWLEDGE_UNIT' END AS layer,
  CASE WHEN len(types) > 0 THEN 'HIGH' WHEN NOT broad AND fuzzy THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM (
  SELECT *, {_has("q", rules.BROAD_WORDS)} AND scope = 'LIBRARY' AS broad, {_has("q", rules.FUZZY_WORDS)} AND len(types) = 0 AS fuzzy, {_has("q", rules.WHOLE_WORDS)} AND len(types) = 0 AS whole FROM (
    SELECT *, {intent} AS intent, {pick(2, _once("t0"))} AS types, {pick(3, _once("s0"))} AS sections FROM (SELECT *, {every(2)} AS t0, {every(3)} AS s0 FROM (
      SELECT *, {flags} FROM (SELECT *, lower(question) AS q, CASE len(list_distinct(list_filter(paper_ids, lambda x: x > 0))) WHEN 0 THEN 'LIBRARY' WHEN 1 THEN 'SINGLE' ELSE 'MULTI' END AS scope FROM asked)))))"""


add_view("plans", ("asked",), _routes_sql())
_JOINED = "array_to_string(types, ',') AS types, array_to_string(sections, ',') AS sections"


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_questions(_asked(spark, sf_dir))


def _told(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("question_id", "scope", "intent", "layer", "confidence", F.array_join("types", ",").alias("types"), F.array_join("sections", ",").alias("sections"), *more)


@query(over(f"SELECT question_id, scope, intent, layer, confidence, {_JOINED} FROM plans", "plans"))
def f1_route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_plans(spark, sf_dir))


@query(over(f"SELECT question_id, confidence <> 'HIGH' OR {_has('lower(question)', rules.MODEL_MARKERS)} AS needs_model FROM plans", "plans"))
def f2_needs_model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.needs_model_route(_plans(spark, sf_dir)).select("question_id", "needs_model")


_RAW = (
    ('```json\n{"intent":"method comparison","knowledgeTypes":["method","Result","bogus"],"sectionTypes":["related work"],"confidence":0.', ',"explanation":"', '"}\n```'),
    ("not json ", " ", ""),
    (" ", None, None),
    ('{"intent":"x","knowledgeTypes":["METRIC"],"confidence":1.', ',"explanation":"', '"}'),
    ('{"intent":"data set","sectionTypes":["appendix","METHOD"],"confidence":0.', ',"explanation":"', '"}'),
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).where("question_id % 6 < 5").withColumn("clean", F.regexp_replace("question", _CLEAN, " "))
    number = F.lpad((F.length("clean") % 100).cast("string"), 2, "0")
    raw = None
    for k, (head, middle, tail) in enumerate(_RAW):
        value = F.concat(F.lit(head), number, F.lit(middle), "clean", F.lit(tail)) if middle else F.lit(head)
        raw = F.when(F.col("question_id") % 6 == k, value) if raw is None else raw.when(F.col("question_id") % 6 == k, value)
    return rows.select("question_id", raw.alias("raw"))


def _chars(text: str) -> str:
    return " || chr(10) || ".join(quoted(x) for x in text.split("\n"))


_RAW_SQL = "CASE question_id % 6 " + " ".join(f"WHEN {k} THEN " + (f"{_chars(h)} || lpad(CAST(length(clean) % 100 AS VARCHAR), 2, '0') || {_chars(m)} || clean || {_chars(t)}" if m else quoted(h)) for k, (h, m, t) in enumerate(_RAW)) + " END"
_NAMES = lambda field, allowed: _once(f"list_filter(list_transform(coalesce(CAST(json_extract(j, '$.{field}') AS VARCHAR[]), []), lambda x: upper(replace(replace(trim(x), '-', '_'), ' ', '_'))), lambda x: list_contains([{listed(allowed)}], x))")
_UNION = lambda a, b: f"list_concat({a}, list_filter({b}, lambda x: NOT list_contains({a}, x)))"
add_view(
    "merged",
    ("plans",),
    f"""SELECT *, CASE WHEN raw IS NULL THEN 'RULE' WHEN fallback_reason IS NULL THEN 'MODEL' ELSE 'RULE_FALLBACK' END AS router_source FROM (
  SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN trim(raw) = '' THEN 'NO_ANSWER' WHEN j IS NULL THEN 'NOT_JSON' WHEN c IS NULL OR c < 0 OR c > 1 THEN 'BAD_CONFIDENCE' WHEN c < {rules.MODEL_LEAST} THEN 'LOW_CONFIDENCE' WHEN len(kinds) + len(parts) = 0 THEN 'NO_LABEL' END AS fallback_reason FROM (
    SELECT *, CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS c, {_NAMES("knowledgeTypes", rules.KNOWLEDGE_LABELS)} AS kinds, {_NAMES("sectionTypes", rules.SECTION_LABELS)} AS parts,
      upper(replace(replace(trim(json_extract_string(j, '$.intent')), '-', '_'), ' ', '_')) AS named FROM (
      SELECT *, CASE WHEN json_valid(bare) THEN bare END AS j FROM (SELECT *, {trimmed("regexp_replace(raw, '```(json|JSON)?', '', 'g')")} AS bare FROM (
        SELECT *, CASE WHEN question_id % 6 < 5 THEN {_RAW_SQL} END AS raw FROM (SELECT *, regexp_replace(question, '{_CLEAN}', ' ', 'g') AS clean FROM plans))))))""",
)


@query(
    over(
        f"""SELECT question_id, scope, router_source, coalesce(fallback_reason, '-') AS fallback_reason, CASE WHEN m AND regexp_matches(named, '^[A-Z][A-Z0-9_]{{1,39}}$') THEN named ELSE intent END AS intent,
  CASE WHEN m AND len(types) + len(kinds) > 0 THEN 'KNOWLEDGE_UNIT' ELSE layer END AS layer, CASE WHEN m THEN CASE WHEN c >= {rules.MODEL_HIGH} THEN 'HIGH' ELSE 'MEDIUM' END ELSE confidence END AS confidence,
  array_to_string(CASE WHEN m THEN {_UNION("types", "kinds")} ELSE types END, ',') AS types, array_to_string(CASE WHEN m THEN {_UNION("sections", "parts")} ELSE sections END, ',') AS sections FROM (SELECT *, router_source = 'MODEL' AS m FROM merged)""",
        "merged",
    )
)
def f3_merge_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routing.merge_routes(_plans(spark, sf_dir), _answers(spark, sf_dir))
    return _told(out, "router_source", F.coalesce("fallback_reason", F.lit("-")).alias("fallback_reason"))


LABELS = (*(f"knowledge_{x}" for x in rules.KNOWLEDGE_LABELS), *(f"section_{x}" for x in rules.SECTION_LABELS))


@query(
    f"""SELECT question_id, valid, CASE WHEN valid THEN low END AS confidence, CASE WHEN valid THEN needed END AS needed FROM (SELECT question_id, bool_and(chosen + 0.00001 >= greatest(p, 1 - p)) AND count(*) FILTER (WHERE choice = 'NEEDED') > 0 AS valid,
  round(min(confidence), 6) AS low, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE choice = 'NEEDED'), '') AS needed FROM (SELECT *, CASE choice WHEN 'NEEDED' THEN p ELSE 1 - p END AS chosen FROM (
    SELECT question_id, {choice(LABELS, "k")} AS label, a / 10.0 AS p, 0.6 + (n + k) % 5 / 10.0 AS confidence, CASE WHEN (a > 5) <> (k = 3 AND n % 4 = 0) THEN 'NEEDED' ELSE 'NOT_NEEDED' END AS choice FROM (
      SELECT item_id AS question_id, length(text) AS n, k, (length(text) + k * 7) % 11 AS a FROM benchmark, (SELECT unnest(range(0, {len(LABELS)})) AS k)))) GROUP BY 1)"""
)
def f4_validate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(len(LABELS) - 1))).alias("k"))
    b = b.withColumn("a", (F.col("n") + F.col("k") * 7) % 11)
    chosen = F.when((F.col("a") > 5) != ((F.col("k") == 3) & (F.col("n") % 4 == 0)), "NEEDED").otherwise("NOT_NEEDED")
    p = F.create_map(F.lit("NEEDED"), F.col("a") / 10, F.lit("NOT_NEEDED"), 1 - F.col("a") / 10, F.lit("UNCERTAIN"), F.lit(0.0))
    rows = b.select("question_id", V.pick(LABELS, F.col("k")).alias("label"), chosen.alias("choice"), (0.6 + (F.col("n") + F.col("k")) % 5 / 10).alias("confidence"), p.alias("probabilities"))
    out = routing.validate_decisions(rows, len(LABELS))
    return out.select("question_id", "valid", F.round("confidence", 6).alias("confidence"), F.array_join("needed", ",").alias("needed"))


HAN_ASKS = ("请问有没有风电功率预测的论文", "把图神经网络方法介绍一下吗", "给出光伏数据集", "")


def _han(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = V.table(spark, sf_dir, "benchmark"), F.col("item_id")
    return b.select(i.alias("question_id"), F.concat("text", F.lit(" "), V.pick(HAN_ASKS, i % 4)).alias("question"), F.concat(F.lit("forecast, "), V.pick(HAN_ASKS, i % 4)).alias("keyword_terms"), F.lit("wind farm; GRU").alias("keyword_query"))


_HAN_LEFT = "regexp_replace(question, '[^\\p{Han}]', ' ', 'g')"
for _phrase in (*rules.STOP_TERMS, *rules.STOP_PHRASES):
    _HAN_LEFT = f"replace({_HAN_LEFT}, '{_phrase}', ' ')"
add_view("han", (), f"SELECT item_id AS question_id, text || ' ' || {choice(HAN_ASKS, 'item_id % 4')} AS question, 'forecast, ' || {choice(HAN_ASKS, 'item_id % 4')} AS keyword_terms, 'wind farm; GRU' AS keyword_query FROM benchmark")
add_view(
    "qterm_lists",
    ("han",),
    f"""SELECT question_id, {_once("l")} AS terms FROM (SELECT question_id, list_concat(regexp_extract_all(question, '{rules.QUESTION_TERM}'), list_filter(list_transform(regexp_split_to_array({_HAN_LEFT}, '\\s+'),
  lambda x: regexp_replace(regexp_replace(x, '^[请把给]', ''), '[有吗呢]$', '')), lambda x: length(x) >= 2)) AS l FROM han)""",
)


@query(over("SELECT question_id, generate_subscripts(terms, 1) - 1 AS pos, unnest(terms) AS term FROM qterm_lists", "qterm_lists"))
def f10_question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.question_terms(_han(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


add_view("catalogs", ("paper_rows",), "SELECT p.paper_id, p.publish_year, concat_ws(' ', p.title, p.keywords, d.text) AS text FROM paper_rows p JOIN documents d ON d.doc_id = (p.paper_id - 1) * 6")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").where("doc_id % 6 = 0").select((F.floor(F.col("doc_id") / 6) + 1).alias("paper_id"), F.col("text").alias("_t"))
    return V.paper_rows(spark, sf_dir).join(d, "paper_id").select("paper_id", "publish_year", F.concat_ws(" ", "title", "keywords", "_t").alias("text"))


_LOOSE = lambda x: f"regexp_replace(lower(coalesce({x}, '')), {quoted(rules.CATALOG_LOOSE)}, '', 'g')"


def _candidates_sql(terms: str, n: int) -> str:
    return f"""SELECT question_id, paper_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, paper_id) AS rank FROM (
  SELECT question_id, paper_id, CASE WHEN len(ts) = 0 THEN round(1.0 + coalesce(publish_year / 10000.0, 0), 8) ELSE list_sum(list_transform(ts, lambda t: CASE WHEN contains(text, t) THEN CASE WHEN length(t) >= 4 THEN 2.0 ELSE 1.0 END ELSE 0.0 END)) END AS score FROM (
    SELECT question_id, list_distinct(list_filter(list_transform({terms}, lambda t: {_LOOSE("t")}), lambda t: t <> '')) AS ts FROM qterm_lists), (SELECT paper_id, publish_year, {_LOOSE("text")} AS text FROM catalogs)) WHERE score > 0 QUALIFY rank <= {n}"""


add_view("candidates", ("qterm_lists", "catalogs"), _candidates_sql("CASE WHEN question_id % 5 = 0 THEN [] ELSE terms END", 5))


def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _han(spark, sf_dir)
    terms = routing.question_terms(asked).where("question_id % 5 <> 0")  # some without terms
    return routing.discover_catalog(asked, terms, _catalog(spark, sf_dir), 5)


@query(over("SELECT question_id, paper_id, round(score, 6) AS score, rank FROM candidates", "candidates"))
def f11_discover_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir).select("question_id", "paper_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_TERM = lambda x: f"length(x) >= 2 AND NOT list_contains([{listed(rules.GENERIC_TERMS)}], lower(x))"


@query(
    over(
        f"""SELECT question_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS term FROM (SELECT question_id, ({_once("l")})[1:{rules.MAX_TERMS}] AS ts FROM (SELECT question_id, list_filter(list_concat(list_concat(regexp_split_to_array(keyword_terms, '{rules.TERM_SPLIT}'), regexp_split_to_array(keyword_query, '{rules.TERM_SPLIT}')),
  list_concat(list_concat(regexp_extract_all(question, '{rules.LATIN_TERM}'), list_filter({_list(rules.KNOWN_TERMS)}, lambda x: contains(lower(question), lower(x)))), CASE WHEN contains(question, '{rules.GRAPH_WORD}') THEN {_list(rules.GRAPH_TERMS)} ELSE {_list(())} END)), lambda x: {_TERM("x")}) AS l FROM han))""",
        "han",
    )
)
def e14_discovery_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.discovery_terms(_han(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


# --- structured evidence

_ORDER = "CASE " + " ".join(f"WHEN {_has('q', words)} THEN {_list(parts)}" for words, parts in rules.SECTION_ORDERS[:-1]) + f" ELSE {_list(rules.SECTION_ORDERS[-1][1])} END"
add_view(
    "wanted",
    ("asked",),
    f"SELECT *, {_ORDER} AS parts FROM (SELECT question_id, lower(question) AS q, generate_subscripts(ids, 1) - 1 AS paper_pos, unnest(ids) AS paper_id FROM (SELECT *, {_once('paper_ids')} AS ids FROM asked))",
)
add_view("profiled", ("chunks",), "SELECT paper_id, content FROM chunks WHERE chunk_index = 0 AND paper_id % 5 <> 0")
_CUT = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '……' ELSE {x} END"


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).where("chunk_index = 0 AND paper_id % 5 <> 0").select("paper_id", "content")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.chunks(spark, sf_dir).select("paper_id", F.col("chunk_id").alias("section_id"), "section_type", "section_title", "content")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search_queries._topped(spark, sf_dir)
    return best.join(V.chunks(spark, sf_dir).select("chunk_id", "paper_id", "section_type", "content"), "chunk_id")


_PLACE = "CASE WHEN list_contains(parts, section_type) THEN list_position(parts, section_type) - 1 ELSE len(parts) + 1 END"


@query(
    over(
        f"""SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY paper_pos, step, n) AS pos, paper_id, layer, key, md5(coalesce(text, '')) AS digest FROM (
  SELECT question_id, paper_pos, w.paper_id, 0 AS step, 0 AS n, CASE WHEN content IS NULL THEN 'error' ELSE 'profile' END AS layer, w.paper_id AS key, {_CUT("content", 1200)} AS text FROM wanted w LEFT JOIN profiled p ON p.paper_id = w.paper_id
  UNION ALL SELECT question_id, paper_pos, paper_id, 1, n, 'summary', chunk_id, {_CUT("content", 1200)} FROM (SELECT question_id, paper_pos, w.paper_id, chunk_id, content, row_number() OVER (PARTITION BY question_id, w.paper_id ORDER BY {_PLACE}, chunk_id) AS n
    FROM wanted w JOIN chunks c ON c.paper_id = w.paper_id) WHERE n <= 3
  UNION ALL SELECT question_id, paper_pos, paper_id, 2, n, 'raw', chunk_id, {_CUT("content", 800)} FROM (SELECT w.question_id, w.paper_pos, w.paper_id, t.chunk_id, c.content, row_number() OVER (PARTITION BY w.question_id, w.paper_id ORDER BY round(t.score, 8) DESC, t.chunk_id) AS n
    FROM topped t JOIN chunks c ON c.chunk_id = t.chunk_id JOIN wanted w ON w.question_id = t.question_id AND w.paper_id = c.paper_id) WHERE n <= 2)""",
        "wanted",
        "profiled",
        "topped",
    )
)
def f8_hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structured.hybrid_context(_asked(spark, sf_dir), _profiles(spark, sf_dir), _summaries(spark, sf_dir), _hits(spark, sf_dir))
    return out.select("question_id", F.col("pos").cast("long").alias("pos"), "paper_id", "layer", "key", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_GAPS = ", ".join(f"({quoted(kind)}, {quoted(part.replace('_', ''))})" for _, kinds, parts in rules.GAP_FAMILIES for kind in kinds for part in parts)
add_view("gap_sections", (), f"SELECT * FROM (VALUES {_GAPS}) t(knowledge_type, part)")
_MATCH = "(contains(replace({s}, '_', ''), part) OR contains(part, replace({s}, '_', '')))"


@query(
    over(
        f"""SELECT paper_id, knowledge_type FROM (SELECT DISTINCT paper_id, knowledge_type FROM units WHERE confidence_level = 'BRONZE') m
  WHERE NOT EXISTS (SELECT 1 FROM chunks c JOIN gap_sections g ON {_MATCH.format(s="c.section_type")} WHERE c.paper_id = m.paper_id AND g.knowledge_type = m.knowledge_type AND c.chunk_id % 3 > 0)""",
        "units",
        "chunks",
        "gap_sections",
    )
)
def f14_uncovered_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = V.units(spark, sf_dir).where("confidence_level = 'BRONZE'").select("paper_id", "knowledge_type").distinct()
    return structured.uncovered_types(missing, V.chunks(spark, sf_dir).where("chunk_id % 3 > 0").select("paper_id", "section_type"))


@query(
    over(
        """SELECT question_id, reason IS NOT NULL AS supplement, coalesce(reason, '-') AS reason FROM (SELECT question_id, CASE WHEN missing > 0 THEN 'MISSING_PAPERS' WHEN confidence = 'LOW' THEN 'VAGUE' WHEN sources = 0 THEN 'NOTHING_FOUND' WHEN scope = 'LIBRARY' AND sources < least(3, candidates) THEN 'FEW_SOURCES' END AS reason FROM (
  SELECT p.question_id, p.scope, p.confidence, coalesce(t.sources, 0) AS sources, coalesce(t.candidates, 0) AS candidates, len(list_filter(list_distinct(p.paper_ids), lambda x: x % 5 = 0)) AS missing FROM plans p
  LEFT JOIN (SELECT question_id, count(*) FILTER (WHERE rank <= question_id % 4) AS sources, count(DISTINCT paper_id) AS candidates FROM topped JOIN chunks USING (chunk_id) GROUP BY 1) t USING (question_id)))""",
        "plans",
        "topped",
        "chunks",
    )
)
def f16_needs_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _plans(spark, sf_dir)
    found = _hits(spark, sf_dir).groupBy("question_id").agg(F.count_if(F.col("rank") <= F.col("question_id") % 4).alias("sources"), F.count_distinct("paper_id").alias("candidates"))
    counts = plans.select("question_id", F.size(F.filter(F.array_distinct("paper_ids"), lambda x: x % 5 == 0)).alias("missing")).join(found, "question_id", "left")
    return structured.needs_supplement(plans, counts).withColumn("reason", F.coalesce("reason", F.lit("-")))


@query()
def f19_structured_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the request, or else of the catalog; the profiled, the units, the sections, then what retrieval adds."""
    plans = written(_plans(spark, sf_dir))
    asked = plans.where("scope <> 'LIBRARY'").select("question_id", F.posexplode(F.array_distinct("paper_ids")).alias("paper_pos", "paper_id"))
    found = _discovered(spark, sf_dir).join(plans.where("scope = 'LIBRARY'").select("question_id"), "question_id", "left_semi")
    candidates = asked.select("question_id", "paper_id", "paper_pos").unionByName(found.select("question_id", "paper_id", F.col("rank").alias("paper_pos")))
    units = V.units(spark, sf_dir).where("verification_status <> 'REJECTED'").withColumn("has_conflict", F.col("unit_id") % 7 == 0)
    rows, decisions = structured.structured_evidence(plans, candidates, _profiles(spark, sf_dir), units, _summaries(spark, sf_dir), _hits(spark, sf_dir), 5)
    return rows.join(decisions, "question_id").select("question_id", F.col("pos").cast("long").alias("pos"), "key", "supplement", F.coalesce("reason", F.lit("-")).alias("reason"))


# --- vector points, fields of model output


@query(
    over(
        f"""SELECT chunk_id, paper_id, section_type, chunk_index, is_reference, is_noise, content_type, md5(embedding_text) AS embedded, preview FROM (SELECT *, 'RAW_CHUNK' AS content_type, CASE WHEN chunk_id % 3 = 0 THEN section_title || ': ' || content ELSE coalesce(content, '') END AS embedding_text,
  substr({trimmed("regexp_replace(regexp_replace(coalesce(content, ''), '[' || chr(1) || '-' || chr(8) || chr(14) || '-' || chr(31) || chr(127) || ']|[^\\x{0}-\\x{FFFF}]', ' ', 'g'), '\\s+', ' ', 'g')")}, 1, 300) AS preview FROM chunks)""",
        "chunks",
    )
)
def a14_build_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.chunks(spark, sf_dir).withColumn("index_text", F.when(F.col("chunk_id") % 3 == 0, F.concat("section_title", F.lit(": "), "content")).when(F.col("chunk_id") % 3 == 1, " "))
    return writing.build_points(rows).select("chunk_id", "paper_id", "section_type", "chunk_index", "is_reference", "is_noise", "content_type", F.md5("embedding_text").alias("embedded"), "preview")


_ONE_LINE = f"trim(regexp_replace(text, '{_CLEAN}', ' ', 'g'))"
_F = rules.PROFILE_FIELDS


@query(
    f"""SELECT doc_id, {", ".join(f"md5(f{i}) AS f{i}" for i in range(7))} FROM (SELECT doc_id, CASE WHEN a = '' THEN '{rules.MISSING_FIELD}' ELSE a END AS f0, lang AS f1, source AS f2, '{rules.MISSING_FIELD}' AS f3, '{rules.MISSING_FIELD}' AS f4, 'k, ' || lang AS f5, whole AS f6 FROM (
  SELECT *, '## 1. **{_F[0]}**： ' || a || chr(10) || '- {_F[1]}: ' || lang || chr(10) || '2、{_F[2]}' || chr(10) || source || chr(10) || '{_F[3]}：' || chr(10) || '{_F[4]}：' || chr(10) || '**{_F[5]}**: k, ' || lang || chr(10) || '{_F[6]}：' AS whole FROM (SELECT *, {_ONE_LINE} AS a FROM documents)))"""
)
def h1_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.trim(F.regexp_replace("text", _CLEAN, " "))
    parts = (F.lit(f"## 1. **{_F[0]}**： "), a, F.lit(f"\n- {_F[1]}: "), F.col("lang"), F.lit(f"\n2、{_F[2]}\n"), F.col("source"), F.lit(f"\n{_F[3]}：\n{_F[4]}：\n**{_F[5]}**: k, "), F.col("lang"), F.lit(f"\n{_F[6]}："))
    out = writing.extract_fields(V.table(spark, sf_dir, "documents").withColumn("text", F.concat(*parts)), _F)
    return out.select("doc_id", *[F.md5(F.col("fields")[i]["value"]).alias(f"f{i}") for i in range(7)])


_FLAT = trimmed("regexp_replace(t, '\\s+', ' ', 'g')")
_BULLETS = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {trimmed('x')}), lambda x: starts_with(x, '-') OR starts_with(x, '•') OR regexp_matches(x, '^\\d+[.)、]'))"


@query(
    f"""SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND useful THEN substr({trimmed("regexp_replace(regexp_replace(t, '(?m)^\\s*[-*]\\s*', '', 'g'), '\\s+', ' ', 'g')")}, 1, 300) WHEN doc_id % 2 = 0 THEN '{rules.MISSING_FIELD}' ELSE 'told' END) AS summary,
  md5(CASE WHEN doc_id % 3 = 0 AND useful THEN array_to_string(({_BULLETS})[1:6], chr(10)) WHEN doc_id % 3 = 0 THEN '' ELSE 'told' END) AS key_points FROM (
    SELECT *, length({_FLAT}) >= 20 AND (NOT regexp_matches({_FLAT}, '{rules.UNUSABLE}') OR length({_FLAT}) > 80) AS useful FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{rules.MISSING_FIELD}' ELSE '- ' || replace(text, '. ', '.' || chr(10) || '2) ') END AS t FROM documents WHERE text IS NOT NULL))"""
)
def h2_fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    t = F.when(i % 5 == 0, rules.MISSING_FIELD).otherwise(F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit(".\n2) "))))
    rows = V.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", t.alias("text"), F.when(i % 2 == 0, rules.MISSING_FIELD).otherwise("told").alias("summary"), F.when(i % 3 == 0, "").otherwise("told").alias("key_points"))
    return writing.fallback_summary(rows).select("doc_id", F.md5("summary").alias("summary"), F.md5("key_points").alias("key_points"))


UNIT_NAMES = ("data set", "Method", "bogus", "")


def _unit(kind: Column, section: Column, value: Column) -> Column:
    return F.concat(F.lit('{"knowledgeType":"'), kind, F.lit('","sectionId":'), section, F.lit(',"subject":"","objectValue":"'), value, F.lit('","evidenceQuote":" q "}'))


@query(
    f"""SELECT batch_id, pos, section_id, knowledge_type, subject_text, predicate_text, md5(object_value) AS value, quote FROM (
  SELECT batch_id, pos, CAST(json_extract_string(u, '$.sectionId') AS BIGINT) AS section_id, CASE WHEN trim(json_extract_string(u, '$.knowledgeType')) = '' THEN 'CONCLUSION' ELSE upper(replace(replace(trim(json_extract_string(u, '$.knowledgeType')), '-', '_'), ' ', '_')) END AS knowledge_type,
    'Title ' || batch_id AS subject_text, 'states' AS predicate_text, json_extract_string(u, '$.objectValue') AS object_value, trim(json_extract_string(u, '$.evidenceQuote')) AS quote FROM (
    SELECT batch_id, generate_subscripts(us, 1) - 1 AS pos, unnest(us) AS u FROM (SELECT batch_id, CAST(json_extract(CASE WHEN batch_id % 4 < 3 THEN body END, CASE WHEN batch_id % 2 = 0 THEN '$' ELSE '$.units' END) AS JSON[]) AS us FROM (
      SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN arr ELSE '{{"units":' || arr || '}}' END AS body FROM (SELECT doc_id AS batch_id, '[' || a || ',' || b || ']' AS arr FROM (
        SELECT doc_id, '{{"knowledgeType":"' || {choice(UNIT_NAMES, "doc_id % 4")} || '","sectionId":' || doc_id || ',"subject":"","objectValue":"' || clean || '","evidenceQuote":" q "}}' AS a,
          '{{"knowledgeType":"result","sectionId":' || (doc_id + doc_id % 2) || ',"subject":"","objectValue":"' || lang || '","evidenceQuote":" q "}}' AS b FROM (SELECT *, regexp_replace(text, '{_CLEAN}', ' ', 'g') AS clean FROM documents)))))))
  WHERE section_id = batch_id AND knowledge_type IN ({listed((*rules.KNOWLEDGE_LABELS, "DATA_SET"))}) AND knowledge_type <> 'DATA_SET' AND trim(object_value) <> ''"""
)
def i3_units_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = V.table(spark, sf_dir, "documents"), F.col("doc_id")
    units = F.concat(F.lit("["), _unit(V.pick(UNIT_NAMES, i % 4), i, F.regexp_replace("text", _CLEAN, " ")), F.lit(","), _unit(F.lit("result"), i + i % 2, F.col("lang")), F.lit("]"))
    body = F.when(i % 2 == 0, units).otherwise(F.concat(F.lit('{"units":'), units, F.lit("}")))
    raw = F.when(i % 4 == 3, F.concat(F.lit("no units in "), "text")).when(i % 4 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    sections = d.select(i.alias("batch_id"), i.alias("section_id"), (F.floor(i / 6) + 1).alias("paper_id"), F.concat(F.lit("Title "), i).alias("title"))
    out = writing.units_from_json(d.select(i.alias("batch_id"), raw.alias("raw")), sections)
    return out.select("batch_id", F.col("pos").cast("long").alias("pos"), "section_id", "knowledge_type", "subject_text", "predicate_text", F.md5("object_value").alias("value"), "quote")


@query(
    over(
        """SELECT paper_id, state, state = 'ready' AS ready, CASE WHEN parse <> 'COMPLETED' THEN parse = 'PROCESSING' WHEN vector <> 'VECTORIZED' THEN vector = 'PROCESSING' ELSE state = 'profileProcessing' END AS processing, suffix(state, 'Failed') AS failed FROM (
  SELECT *, CASE WHEN parse <> 'COMPLETED' THEN CASE WHEN parse = 'FAILED' THEN 'parseFailed' ELSE 'pendingParse' END WHEN vector <> 'VECTORIZED' THEN CASE WHEN vector = 'ERROR' THEN 'vectorFailed' ELSE 'pendingVector' END WHEN job = 'PROCESSING' THEN 'profileProcessing'
    WHEN job = 'FAILED' THEN 'profileFailed' WHEN paper_id % 5 = 0 THEN 'pendingProfile' WHEN paper_id % 4 = 1 THEN 'pendingProfileIndex' ELSE 'ready' END AS state FROM (
    SELECT paper_id, CASE WHEN paper_id % 13 = 0 THEN 'PROCESSING' ELSE parse_status END AS parse, ['VECTORIZED', 'ERROR', 'PROCESSING'][CASE WHEN paper_id % 9 < 7 THEN 1 ELSE paper_id % 9 - 5 END] AS vector, status AS job FROM paper_rows LEFT JOIN (
      SELECT paper_id, max_by(status, (create_time, job_id)) AS status FROM jobs GROUP BY 1) j USING (paper_id)))""",
        "paper_rows",
        "jobs",
    )
)
def h10_workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("paper_id")
    last = V.jobs(spark, sf_dir).groupBy("paper_id").agg(F.max_by("status", F.struct("create_time", "job_id")).alias("job_status"))
    rows = V.paper_rows(spark, sf_dir).join(last, "paper_id", "left").withColumns(
        {
            "parse_status": F.when(p % 13 == 0, "processing").otherwise(F.col("parse_status")),
            "vector_status": F.when(p % 9 < 7, "Vectorized").when(p % 9 == 7, "ERROR").otherwise("PROCESSING"),
            "has_profile": p % 5 != 0,
            "index_complete": p % 4 != 1,
        }
    )
    return writing.workflow_state(rows).select("paper_id", "state", "ready", "processing", "failed")


# --- ideas and drafts

_POINTS = "CASE " + " ".join(f"WHEN regexp_matches(upper(section_type), '{p}') THEN {n}" for n, p in rules.SECTION_POINTS) + " ELSE 1 END"


@query(
    over(
        f"""SELECT idea_id, chunk_id, points, pos FROM (SELECT *, row_number() OVER (PARTITION BY idea_id, paper_id ORDER BY points DESC, chunk_index) AS pos FROM (
  SELECT idea_id, i.paper_id, chunk_id, chunk_index, 5 * len(list_filter(words, lambda w: contains(lower(section_title || ' ' || content), w))) + {_POINTS} AS points FROM (
    SELECT doc_id AS idea_id, doc_id // 6 + 1 AS paper_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3)) AS words FROM documents WHERE doc_id % 6 = 1) i JOIN chunks c USING (paper_id))) WHERE pos <= 2""",
        "chunks",
    )
)
def j17_idea_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ideas = V.table(spark, sf_dir, "documents").where("doc_id % 6 = 1").select(F.col("doc_id").alias("idea_id"), (F.floor(F.col("doc_id") / 6) + 1).alias("paper_id"), "text")
    out = writing.idea_evidence(ideas, V.chunks(spark, sf_dir), F.concat_ws(" ", "section_title", "content"), R.points(F.col("section_type"), rules.SECTION_POINTS), 5, "chunk_index", 2)
    return out.select("idea_id", "chunk_id", "points", F.col("pos").cast("long").alias("pos"))


IDEA_ASKS = ("", "How does this compare: ", "Future work? ", "优化 ")
VERDICTS = ("是", "Yes", "否", "no, yes")


@query(
    f"""SELECT conv_id, turn, coalesce(CASE WHEN turn % 5 > 0 AND regexp_matches(q, '(?i){rules.IMPROVEMENT_INTENT}') THEN 'ASKED' WHEN turn % 5 > 0 AND regexp_matches(q, '(?i){rules.RESEARCH_GATE}') AND (conv_id + turn) % 4 < 2 THEN 'ANSWERED' END, '-') AS reason
  FROM (SELECT conv_id, turn, {choice(IDEA_ASKS, "turn % 4")} || coalesce(text, '') AS q FROM conversations)"""
)
def k4_suggest_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    rows = V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(V.pick(IDEA_ASKS, t % 4), F.coalesce("text", F.lit(""))).alias("question"), F.when(t % 5 > 0, F.concat(F.lit("A: "), F.coalesce("text", F.lit("")))).otherwise("  ").alias("answer"), V.pick(VERDICTS, (F.col("conv_id") + t) % 4).alias("verdict")
    )
    return writing.suggest_ideas(rows).select("conv_id", "turn", F.coalesce("reason", F.lit("-")).alias("reason"))


add_view(
    "best_chunks",
    ("chunks",),
    f"SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY quality_score DESC NULLS LAST, chunk_index, chunk_id) AS n FROM chunks WHERE section_type IN ({listed(rules.WRITING_SECTIONS)}) AND NOT is_reference AND NOT is_noise AND {trimmed('content')} <> ''",
)


@query(over("SELECT m.project_id, m.paper_id, p.title, b.chunk_id, md5(coalesce(substr(b.content, 1, 360), '')) AS excerpt FROM (SELECT DISTINCT project_id, paper_id FROM marks) m JOIN paper_rows p ON p.paper_id = m.paper_id LEFT JOIN (SELECT * FROM best_chunks WHERE n = 1) b ON b.paper_id = m.paper_id", "marks", "paper_rows", "best_chunks"))
def k8_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = writing.bibliography(table_queries._drafts(spark, sf_dir), V.paper_rows(spark, sf_dir), V.chunks(spark, sf_dir))
    return out.select("project_id", "paper_id", "title", "chunk_id", F.md5(F.coalesce("excerpt", F.lit(""))).alias("excerpt"))


@query(
    over(
        f"""SELECT project_id, length(evidence) AS chars, md5(evidence) AS digest FROM (SELECT project_id, substr(string_agg(block, '' ORDER BY pos), 1, 9000) AS evidence FROM (
  SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM (
    SELECT project_id, generate_subscripts(ids, 1) AS pos, unnest(ids) AS paper_id FROM (SELECT paper_id AS project_id, [paper_id, paper_id + 1, paper_id + 2] AS ids FROM paper_rows)) JOIN (
    SELECT paper_id, string_agg(line, chr(10) ORDER BY step, n) || chr(10) AS block FROM (
      SELECT paper_id, 0 AS step, 0 AS n, '=== [P' || paper_id || '] ===' || chr(10) || coalesce(title, '') || chr(10) || coalesce(CAST(publish_year AS VARCHAR), '?') AS line FROM paper_rows
      UNION ALL SELECT paper_id, 1, 0, substr(coalesce(content, ''), 1, 2600) FROM profiled
      UNION ALL SELECT paper_id, 2, n, '[' || coalesce(section_title, '') || '] ' || substr(coalesce(content, ''), 1, 700) FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) AS n FROM chunks WHERE section_type IN ({listed(rules.WRITING_SECTIONS)})) WHERE n <= 3
      UNION ALL SELECT paper_id, 3, n, 'chunk#' || chunk_id || ' ' || substr(coalesce(content, ''), 1, 900) FROM best_chunks WHERE n <= 3) GROUP BY 1) USING (paper_id)) WHERE ahead < 9000 GROUP BY 1)""",
        "paper_rows",
        "profiled",
        "best_chunks",
    )
)
def k9_writing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, p_rows = F.col("paper_id"), V.paper_rows(spark, sf_dir)
    projects = p_rows.select(p.alias("project_id"), F.array(p, p + 1, p + 2).alias("paper_ids"))
    profiles = _profiles(spark, sf_dir)
    profiles = profiles.withColumn("update_time", F.lit(2)).unionByName(profiles.select("paper_id", F.lit("older").alias("content"), F.lit(1).alias("update_time")))
    out = writing.writing_evidence(projects, p_rows, profiles, _summaries(spark, sf_dir), V.chunks(spark, sf_dir), 9000)
    return out.select("project_id", F.length("evidence").cast("long").alias("chars"), F.md5("evidence").alias("digest"))


@query(
    f"""SELECT project_id, generate_subscripts(heads, 1) - 1 AS pos, unnest(heads) AS heading, CAST(greatest(300, target // len(heads)) AS BIGINT) AS words FROM (SELECT project_id, target, CASE kind WHEN 0 THEN CASE WHEN clean = '' THEN ['Two', source, lang] ELSE [clean, 'Two', source, lang] END WHEN 2 THEN {_list(rules.DEFAULT_OUTLINE[:1])} ELSE {_list(rules.DEFAULT_OUTLINE)} END AS heads FROM (
  SELECT doc_id AS project_id, doc_id % 4 AS kind, 1000 + doc_id % 900 AS target, trim(regexp_replace(text, '{_CLEAN}', ' ', 'g')) AS clean, source, lang FROM documents))"""
)
def k10_parse_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, clean = F.col("doc_id"), F.regexp_replace("text", _CLEAN, " ")
    head = lambda x, ids="[1,2]": F.concat(F.lit('{"heading":"'), x, F.lit(f'","sourcePaperIds":{ids}}}'))
    listed_ = F.concat(F.lit('Here: {"sections":['), head(clean), F.lit(","), head(F.lit(" Two ")), F.lit(","), head(F.lit("  ")), F.lit(","), head(F.col("source")), F.lit(',{"heading":"'), "lang", F.lit('"}]} done'))
    foreign = F.concat(F.lit('{"sections":['), head(clean, "[1,99]"), F.lit("]}"))
    blank = F.concat(F.lit('{"sections":['), head(F.lit(" ")), F.lit("]}"))
    raw = F.when(i % 4 == 0, listed_).when(i % 4 == 1, foreign).when(i % 4 == 2, blank).otherwise(F.concat(F.lit("no outline: "), clean))
    rows = V.table(spark, sf_dir, "documents").select(i.alias("project_id"), raw.alias("raw"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("allowed_ids"), (1000 + i % 900).alias("target_words"))
    return writing.parse_outlines(rows).select("project_id", F.col("pos").cast("long").alias("pos"), "heading", "words")


add_view("revs", (), "SELECT user_id AS project_id, event_id AS revision_id, event_type AS kind, 'text ' || event_type || ' ' || event_id AS content, ts AS create_time FROM events")


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("text "), "event_type", F.lit(" "), "event_id")
    return V.table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("revision_id"), F.col("event_type").alias("kind"), text.alias("content"), F.col("ts").alias("create_time"))


@query(over("SELECT project_id, revision_id, row_number() OVER (PARTITION BY project_id ORDER BY create_time DESC, revision_id DESC) AS pos FROM revs", "revs"))
def k11_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writing.revisions(_revisions(spark, sf_dir)).select("project_id", "revision_id", F.col("pos").cast("long").alias("pos"))


@query(
    over(
        """SELECT project_id, revision_id, kind, content FROM (SELECT project_id, revision_id, kind, 'text ' || kind || ' ' || revision_id AS content FROM revs
  UNION ALL SELECT project_id, last + 1, 'VERSION_RESTORED', 'text ' || kind || ' ' || revision_id FROM (SELECT *, max(revision_id) OVER (PARTITION BY project_id) AS last, row_number() OVER (PARTITION BY project_id ORDER BY revision_id) AS n FROM revs) WHERE n = 1 AND project_id % 4 > 0)""",
        "revs",
    )
)
def k11_restore_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _revisions(spark, sf_dir), F.col("project_id")
    chosen = rows.groupBy("project_id").agg(F.min("revision_id").alias("revision_id"), F.max("create_time").alias("at"))
    chosen = chosen.withColumn("revision_id", F.when(p % 4 == 0, -1).otherwise(F.col("revision_id")))  # some of no project
    return writing.restore_revisions(rows, chosen).select("project_id", "revision_id", "kind", "content")
