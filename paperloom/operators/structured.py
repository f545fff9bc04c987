"""Evidence from structured tables first: contexts of several papers, gaps and what retrieval must add."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import has_any
from paperloom.operators.evidence import merge_evidence
from paperloom.operators.knowledge import mapped, tier_rank
from paperloom.sources.scratch import written

Q = "question_id"


def _letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def _section_fits(section: Column, targets: Column) -> Column:
    """Whether a section's letters hold those of a target, or the other way."""
    name = _letters(section)
    return (name != "") & F.exists(F.transform(targets, _letters), lambda t: (t != "") & (name.contains(t) | t.contains(name)))


def gap_family(kind: Column) -> Column:
    return mapped(kind, tuple((f, members) for f, members, _ in rules.GAP_FAMILIES), kind)


def expected_sections(kind: Column) -> Column:
    """array<string>: the sections that may fill a gap of a knowledge label; none for unknown ones."""
    table = F.create_map(*chain.from_iterable((F.lit(f), F.array(*[F.lit(s) for s in parts])) for f, _, parts in rules.GAP_FAMILIES))
    return F.coalesce(F.try_element_at(table, gap_family(kind)), F.array().cast("array<string>"))


def clipped(text: Column, chars: int) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("……"))).otherwise(text)


def section_order(question: Column) -> Column:
    """array<string>: the sections to read first, by words of the question."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.array(*[F.lit(s) for s in rules.SECTION_ORDERS[-1][1]])
    for words, parts in reversed(rules.SECTION_ORDERS[:-1]):
        out = F.when(has_any(q, words), F.array(*[F.lit(s) for s in parts])).otherwise(out)
    return out


def hybrid_context(requests: DataFrame, profiles: DataFrame, summaries: DataFrame, hits: DataFrame, n_summaries: int = 3, n_raw: int = 2) -> DataFrame:
    """question_id, pos, paper_id, layer, key, text: for each requested paper its profile, summaries and best raw hits.

    Papers keep the order of the request (question_id, question, paper_ids); summaries (paper_id, section_id,
    section_type, content) come in the order that the question asks for, hits (question_id, paper_id, chunk_id, score,
    content) by score. A paper without a profile gives a row of layer ``error``.
    """
    ids = F.array_distinct(F.filter("paper_ids", lambda x: x > 0))
    wanted = requests.select(Q, section_order(F.col("question")).alias("first"), F.posexplode(ids).alias("paper_pos", "paper_id"))
    told = wanted.join(profiles.select("paper_id", F.col("content").alias("text")), "paper_id", "left")
    lead = told.select(
        Q, "paper_pos", "paper_id", F.lit(0).alias("step"), F.lit(0).alias("n"), F.when(F.col("text").isNull(), "error").otherwise("profile").alias("layer"), F.col("paper_id").alias("key"), clipped(F.col("text"), 1200).alias("text")
    )
    place = F.array_position("first", F.upper(F.coalesce("section_type", F.lit("UNKNOWN"))))
    rows = wanted.join(summaries, "paper_id").withColumn("place", F.when(place > 0, place - 1).otherwise(F.size("first") + 1))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(Q, "paper_id").orderBy("place", "section_id"))).where(F.col("n") <= n_summaries)
    middle = rows.select(Q, "paper_pos", "paper_id", F.lit(1).alias("step"), "n", F.lit("summary").alias("layer"), F.col("section_id").alias("key"), clipped(F.col("content"), 1200).alias("text"))
    raw = hits.join(wanted, [Q, "paper_id"]).withColumn("n", F.row_number().over(Window.partitionBy(Q, "paper_id").orderBy(F.desc_nulls_last("score"), "chunk_id"))).where(F.col("n") <= n_raw)
    tail = raw.select(Q, "paper_pos", "paper_id", F.lit(2).alias("step"), "n", F.lit("raw").alias("layer"), F.col("chunk_id").alias("key"), clipped(F.col("content"), 800).alias("text"))
    every = lead.unionByName(middle).unionByName(tail)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy(Q).orderBy("paper_pos", "step", "n"))).select(Q, "pos", "paper_id", "layer", "key", "text")


def uncovered_types(missing: DataFrame, summaries: DataFrame, by: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """Rows of ``missing`` (``by``, knowledge_type) whose expected sections no summary (``by``, section_type) of theirs covers."""
    parts = summaries.select(*by, "section_type").distinct()
    filled = missing.join(parts, list(by)).where(_section_fits(F.col("section_type"), expected_sections(F.col("knowledge_type"))))
    return missing.join(filled.select(*by, "knowledge_type").distinct(), [*by, "knowledge_type"], "left_anti")


def needs_supplement(plans: DataFrame, counts: DataFrame) -> DataFrame:
    """question_id, supplement, reason for plans (scope, confidence) and counts (sources, candidates, missing)."""
    rows = plans.select(Q, "scope", "confidence").join(counts, Q, "left").na.fill(0, ["sources", "candidates", "missing"])
    thin = (F.col("scope") == "LIBRARY") & (F.col("sources") < F.least(F.lit(3), "candidates"))
    reason = F.when(F.col("missing") > 0, "MISSING_PAPERS").when(F.col("confidence") == "LOW", "VAGUE").when(F.col("sources") == 0, "NOTHING_FOUND").when(thin, "FEW_SOURCES")
    return rows.select(Q, reason.isNotNull().alias("supplement"), reason.alias("reason"))


def _first_sections(wanted: DataFrame, summaries: DataFrame, targets: str, n: int) -> DataFrame:
    """The first ``n`` summaries of each question's paper that fit its targets; without targets, of all."""
    rows = wanted.join(summaries, "paper_id").where((F.size(targets) == 0) | _section_fits(F.col("section_type"), F.col(targets)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(Q, "paper_id").orderBy("section_id"))).where(F.col("n") <= n)
    return rows.select(Q, "paper_id", "paper_pos", "n", "section_type", F.concat(F.lit("summary:"), "section_id").alias("key"))


def structured_evidence(plans: DataFrame, candidates: DataFrame, profiles: DataFrame, units: DataFrame, summaries: DataFrame, retrieved: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(evidence, decisions) of routed questions.

    ``plans`` as from ``route_questions``; ``candidates`` (question_id, paper_id, paper_pos); ``profiles`` (paper_id);
    ``units`` (unit_id, paper_id, knowledge_type, confidence_level, has_conflict); ``summaries`` (paper_id, section_id,
    section_type); ``retrieved`` (question_id, paper_id, chunk_id, section_type, rank). Every plan reads its own layers;
    a wanted label without a sure unit falls back to the sections that should hold it, a paper without any source to its
    first sections. What is then missing is retrieved for those papers only, else, if the question is vague or little
    was found, for all candidates. evidence: question_id, pos, key. decisions: question_id, supplement, reason.

    Steps that later ones read more than once are written, or the plan would hold each of them again for every path to it.
    """
    plans = written(plans.select(Q, "scope", "layer", "confidence", "types", "sections"))
    wanted = written(plans.join(candidates, Q))
    layer = F.col("layer")

    def stage(rows: DataFrame, no: int) -> DataFrame:
        return rows.select(Q, "paper_id", "key", F.lit(no).alias("step"), "paper_pos", "n")

    lead = wanted.where(layer.isin("PAPER_PROFILE", "PROFILE_AND_SECTION", "PAPER_CATALOG")).join(profiles.select("paper_id"), "paper_id")
    lead = stage(lead.withColumns({"key": F.concat(F.lit("profile:"), "paper_id"), "n": F.lit(1)}), 0)
    typed = (F.size("types") == 0) | F.array_contains("types", F.col("knowledge_type"))
    known = wanted.where(layer.isin("KNOWLEDGE_UNIT", "PAPER_CATALOG")).join(units, "paper_id").where(typed)
    order = Window.partitionBy(Q, "paper_id").orderBy(F.desc(tier_rank(F.col("confidence_level"))), "unit_id")
    known = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(2, min(k, 6))).withColumn("key", F.concat(F.lit("knowledge:"), "unit_id"))
    known = written(known.select(Q, "paper_id", "paper_pos", "key", "n", "knowledge_type", "confidence_level", "has_conflict"))
    sure = known.where(F.col("confidence_level").isin("GOLD", "SILVER") & ~F.coalesce("has_conflict", F.lit(False)))
    sure = sure.select(Q, "paper_id", gap_family(F.col("knowledge_type")).alias("family")).distinct()
    gaps = wanted.where((layer == "KNOWLEDGE_UNIT") & (F.size("types") > 0)).select(Q, "paper_id", "paper_pos", "sections", F.explode("types").alias("knowledge_type"))
    gaps = written(gaps.withColumn("family", gap_family(F.col("knowledge_type"))).join(sure, [Q, "paper_id", "family"], "left_anti"))
    asked = gaps.groupBy(Q, "paper_id", "paper_pos").agg(F.array_distinct(F.flatten(F.collect_list(expected_sections(F.col("knowledge_type"))))).alias("fallback"), F.first("sections").alias("sections"))
    asked = asked.withColumn("fallback", F.when(F.size("fallback") > 0, F.col("fallback")).otherwise(F.col("sections")))
    filled = written(_first_sections(asked, summaries, "fallback", 4))
    both = _first_sections(wanted.where(layer == "PROFILE_AND_SECTION"), summaries, "sections", 4)
    found = written(stage(known, 1).unionByName(lead).unionByName(stage(filled, 2)).unionByName(stage(both, 3)))
    bare = wanted.join(found.select(Q, "paper_id").distinct(), [Q, "paper_id"], "left_anti")
    found = written(found.unionByName(stage(_first_sections(bare, summaries, "sections", 3), 4)))

    open_gaps = uncovered_types(gaps.select(Q, "paper_id", "knowledge_type"), filled, (Q, "paper_id")).select(Q, "paper_id")
    nothing = wanted.select(Q, "paper_id").join(found.select(Q, "paper_id").distinct(), [Q, "paper_id"], "left_anti")
    missing = written(open_gaps.unionByName(nothing).distinct())
    counts = wanted.groupBy(Q).agg(F.count_distinct("paper_id").alias("candidates")).join(found.groupBy(Q).agg(F.count_distinct("key").alias("sources")), Q, "left")
    counts = counts.join(missing.groupBy(Q).agg(F.count("*").alias("missing")), Q, "left")
    decisions = written(needs_supplement(plans, counts))

    some = missing.select(Q, F.lit(True).alias("some")).distinct()
    scope = wanted.select(Q, "paper_id", "sections").join(missing.withColumn("lacks", F.lit(True)), [Q, "paper_id"], "left").join(some, Q, "left")
    scope = scope.where(F.col("some").isNull() | F.col("lacks")).join(decisions.where("supplement").select(Q), Q, "left_semi")
    rows = retrieved.join(scope.select(Q, "paper_id", "sections"), [Q, "paper_id"]).withColumn("fits", (F.size("sections") == 0) | _section_fits(F.col("section_type"), F.col("sections")))
    rows = rows.withColumn("any", F.max("fits").over(Window.partitionBy(Q))).where(F.col("fits") | ~F.col("any"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(Q).orderBy("rank", "chunk_id"))).where(F.col("n") <= max(2, k))
    added = rows.select(Q, F.concat(F.lit("chunk:"), "chunk_id").alias("key"), F.col("n").alias("rank"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(Q).orderBy("step", "paper_pos", "n", "key")))
    return merge_evidence(ranked.select(Q, "key", "rank"), added, max(2 * k, 8)), decisions
