"""Questions, ideas, drafts, model output and run quality: small table-level operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import token_estimate, trim_all
from paperloom.operators.text import summarizable_chunks, usable_chunks


def query_variants(questions: DataFrame, columns: tuple[str, ...], fallback: str = "question") -> DataFrame:
    """question_id, pos, variant: trimmed variants that are not blank, each once; without any, the question itself."""
    parts = F.array_distinct(F.filter(F.array(*[trim_all(F.col(c)) for c in columns]), lambda x: x.isNotNull() & (x != "")))
    return questions.select("question_id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(fallback))).alias("pos", "variant"))


def term_matches(text: Column, terms: Column) -> Column:
    """How many distinct terms of two or more characters a text contains, without case."""
    low = F.transform(terms, lambda x: F.lower(trim_all(x)))
    return F.size(F.array_distinct(F.filter(low, lambda x: (F.length(x) >= 2) & F.lower(text).contains(x)))).cast("long")


def filter_by_section(hits: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Hits whose section's letters hold a target's, or the other way; a question left with none keeps all its hits."""
    letters = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))
    name, fits = letters(F.col("section_type")), F.lit(False)
    for t in targets:
        bare = "".join(x for x in t.upper() if x.isalpha())
        fits = fits | ((name != "") & (name.contains(bare) | F.lit(bare).contains(name)))
    rows = hits.withColumn("_fits", fits)
    return rows.withColumn("_any", F.max("_fits").over(Window.partitionBy("question_id"))).where(F.col("_fits") | ~F.col("_any")).drop("_fits", "_any")


def needs_history(question: Column) -> Column:
    """Whether a question leans on what was said before: not if it names a paper; if it points back, or is very short."""
    short = (F.length(question) <= 12) & ~question.rlike("[A-Za-z]{3,}")
    return ~question.rlike(rules.EXPLICIT_PAPER) & (question.rlike(rules.NEEDS_CONTEXT) | short)


def session_papers(msgs: DataFrame, json: str = "sources_json") -> DataFrame:
    """session_id, paper_ids: every positive paperId at any depth of the messages' JSON, each once, in order."""
    found = F.regexp_extract_all(F.col(json), F.lit(r'"paperId"\s*:\s*"?\s*(\d+)'), F.lit(1))
    ids = msgs.select("session_id", "msg_id", F.posexplode(F.transform(found, lambda x: x.try_cast("long"))).alias("pos", "paper_id")).where("paper_id > 0")
    firsts = ids.groupBy("session_id", "paper_id").agg(F.min(F.struct("msg_id", "pos")).alias("at"))
    listed = firsts.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("at", "paper_id"))).alias("s"))
    return listed.select("session_id", F.array_join(F.transform("s", lambda x: x["paper_id"].cast("string")), ",").alias("paper_ids"))


def flex_string(raw: Column) -> Column:
    """A JSON value as text: arrays joined by a full-width semicolon, null and empty arrays null, anything else as it is."""
    items = F.from_json(raw, "array<string>")
    joined = F.array_join(F.filter(items, lambda x: x.isNotNull()), "；")
    scalar = F.when(raw == "null", F.lit(None)).when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)
    return F.when(trim_all(raw).startswith("["), F.when(joined == "", F.lit(None)).otherwise(joined)).otherwise(scalar)


def salvage_json(raw: Column, field: str, chars: int = 30) -> Column:
    """A field of the object between the first brace and the last; without one, the start of the text."""
    value = F.get_json_object(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), f"$.{field}")
    return F.coalesce(value, F.substring(raw, 1, chars))


def section_material(chunks: DataFrame, chars: int = 8000) -> DataFrame:
    """paper_id, section_type, material, chunk_ids, tokens: a section's chunks in order, cut."""
    row = F.struct("chunk_index", "chunk_id", trim_all(F.col("content")).alias("t"), token_estimate(F.col("content")).alias("n"))
    rows = summarizable_chunks(chunks).groupBy("paper_id", "section_type").agg(F.sort_array(F.collect_list(row)).alias("rs"))
    ids = F.array_join(F.transform("rs", lambda x: x["chunk_id"].cast("string")), ",")
    tokens = F.aggregate("rs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return rows.select("paper_id", "section_type", F.substring(F.array_join("rs.t", "\n\n"), 1, chars).alias("material"), ids.alias("chunk_ids"), tokens.alias("tokens"))


def profile_material(chunks: DataFrame, chars: int = 12000) -> DataFrame:
    """paper_id, material: headed chunks in order, the last one cut where the limit falls."""
    part = F.concat(F.lit("["), "section_title", F.lit("]\n"), "content", F.lit("\n\n"))
    rows = usable_chunks(chunks).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", part.alias("t")))).alias("rs"))
    return rows.select("paper_id", F.substring(F.array_join("rs.t", ""), 1, chars).alias("material"))


def vision_eligible(assets: DataFrame, version: str) -> DataFrame:
    """Figures, tables and equations that no one reviewed, not analysed at this version, whose words promise facts."""
    caption = F.lower(F.coalesce("caption", F.lit("")))
    words = F.concat_ws(" ", caption, F.lower(F.coalesce("raw_text", F.lit(""))))
    unsure = F.coalesce("confidence", F.lit(0.0)) < rules.VISION_CONFIDENCE
    kind = F.col("asset_type")
    worth = (
        F.when(kind == "FIGURE", caption.rlike(rules.VISION_FIGURE))
        .when(kind == "TABLE", unsure & words.rlike(rules.VISION_TABLE))
        .when(kind == "EQUATION", unsure & words.rlike(rules.VISION_EQUATION))
        .otherwise(False)
    )
    done = F.coalesce(F.col("analysis_version") == version, F.lit(False))
    return assets.where(worth & ~done & ~F.coalesce("verification_status", F.lit("")).isin("USER_CONFIRMED", "REJECTED"))


def points(text: Column, table, default: int = 1) -> Column:
    """The points of the first pattern that an upper-case text matches."""
    out = None
    for n, pattern in table:
        test = F.upper(F.coalesce(text, F.lit(""))).rlike(pattern)
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.otherwise(default).cast("long")


def top_by_points(rows: DataFrame, score: Column, tie: str, n: int, key: str = "paper_id") -> DataFrame:
    """The ``n`` rows of each key with most points, ties by ``tie``, with points and pos."""
    rows = rows.withColumn("points", score)
    order = Window.partitionBy(key).orderBy(F.desc("points"), F.asc_nulls_last(tie))
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= n)


# --- ideas and drafts


def search_ideas(ideas: DataFrame, keyword: str, **equal: str) -> DataFrame:
    """Ideas whose title or tags hold the keyword, without case, and whose columns equal the given values."""
    k = keyword.lower()
    rows = ideas.where(F.lower("title").contains(k) | F.lower("tags").contains(k))
    for column, value in equal.items():
        rows = rows.where(F.lower(column) == value.lower())
    return rows.orderBy(F.desc("update_time"), "idea_id")


def idea_counts(ideas: DataFrame) -> DataFrame:
    """One row: ideas of each known save type and their sum; other types do not count."""
    counts = [F.count_if(F.col("save_type") == t).alias(t) for t in rules.SAVE_TYPES]
    return ideas.agg(*counts).withColumn("total", sum((F.col(t) for t in rules.SAVE_TYPES), F.lit(0)))


def dedupe_ideas(ideas: DataFrame) -> DataFrame:
    """session_id, idea_id: the first idea of each chat session."""
    return ideas.where("source_type = 'rag_chat' AND session_id IS NOT NULL").groupBy("session_id").agg(F.min("idea_id").alias("idea_id"))


def normalize_citations(docs: DataFrame, allowed: DataFrame, key: str, text: str = "content") -> DataFrame:
    """Marks [P<id>] of papers that are not allowed become a placeholder. ``allowed``: one row (key, ids) for a draft."""
    rows = docs.join(allowed.select(key, F.col("ids").alias("_ids")), key, "left")
    parts = F.split(F.col(text), r"(?=\[P\d+\])|(?<=\[P\d{1,18}\])")
    ids = F.coalesce("_ids", F.array().cast("array<bigint>"))
    fixed = F.transform(parts, lambda p: F.when(p.rlike(r"^\[P\d+\]$") & ~F.coalesce(F.array_contains(ids, F.regexp_extract(p, r"(\d+)", 1).try_cast("long")), F.lit(False)), rules.MISSING_SOURCE).otherwise(p))
    return rows.withColumn(text, F.array_join(fixed, "")).drop("_ids")


def validate_selection(projects: DataFrame, papers: DataFrame, most: int = 20) -> DataFrame:
    """project_id, requested, missing, refused: ids that are no paper, and selections that are too large."""
    rows = projects.select("project_id", F.explode("paper_ids").alias("paper_id")).join(papers.select("paper_id", F.lit(True).alias("ok")), "paper_id", "left")
    out = rows.groupBy("project_id").agg(F.count("*").alias("requested"), F.count_if(F.col("ok").isNull()).alias("missing"))
    return out.withColumn("refused", F.col("requested") > most)


# --- runs


def usage_rollup(calls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Calls by variant: tokens that are known and how many calls do not tell, successes and time."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("unknown"), F.count_if("ok").alias("ok"), F.round(F.sum("ms"), 4).alias("ms")
    )


def guard_metrics(runs: DataFrame, by: str) -> DataFrame:
    """Shares of a run's results: inside their scope, of references or noise; of its strategy and keywords; and whether
    it used more than one granularity.

    ``runs`` has in_scope, contaminated, source_type, right_strategy and keyword_share for every result of a run.
    """
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return runs.groupBy(by).agg(
        share("in_scope").alias("purity"), share("contaminated").alias("contamination"), share("right_strategy").alias("strategy_accuracy"),
        (F.count_distinct("source_type") > 1).alias("multi_granularity"), share("keyword_share").alias("keyword_coverage"),
    )
