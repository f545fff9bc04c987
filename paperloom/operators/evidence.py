"""Choosing a strategy for questions and packing evidence under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import collapse, has_any, token_estimate
from paperloom.operators.text import drop_low_value, usable_chunks

Q = "question_id"


def choose_strategy(requests: DataFrame, papers: DataFrame, chunks: DataFrame, profiles: DataFrame, budget: int = 60_000) -> DataFrame:
    """question_id, strategy for requests (question_id, paper_ids).

    No papers: DISCOVERY. Several: HYBRID if all have profiles, else VECTOR. One: FULL_TEXT if it is parsed and its
    usable text has at most ``budget`` tokens, else VECTOR.
    """
    sizes = usable_chunks(chunks).groupBy("paper_id").agg(F.sum(token_estimate(F.col("content"))).alias("tokens"))
    wanted = requests.select(Q, F.explode_outer("paper_ids").alias("paper_id"))
    known = papers.select("paper_id", "parse_status").join(profiles.select("paper_id", F.lit(True).alias("profiled")).distinct(), "paper_id", "left").join(sizes, "paper_id", "left")
    rows = wanted.join(known, "paper_id", "left").groupBy(Q).agg(
        F.count("paper_id").alias("n"), F.bool_and(F.coalesce("profiled", F.lit(False))).alias("all_profiled"), F.bool_and(F.coalesce(F.col("parse_status") == "COMPLETED", F.lit(False))).alias("parsed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    fits = F.col("parsed") & (F.col("tokens") > 0) & (F.col("tokens") <= budget)
    strategy = F.when(F.col("n") == 0, "DISCOVERY").when(F.col("n") > 1, F.when(F.col("all_profiled"), "HYBRID").otherwise("VECTOR")).otherwise(F.when(fits, "FULL_TEXT").otherwise("VECTOR"))
    return rows.select(Q, strategy.alias("strategy"))


def fold_budget(items: Column, budget: int) -> Column:
    """Items struct<text, section> taken in order under a budget of tokens.

    Inside a section the first item that does not fit ends the section; if it is the section's first, everything ends.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("used"), F.lit("").alias("section"), F.lit(False).alias("closed"), F.lit(False).alias("ended"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["section"] != x["section"]
        closed = F.when(fresh, False).otherwise(s["closed"])
        fits = s["used"] + x["tokens"] <= budget
        take = fits & ~closed & ~s["ended"]
        return F.struct(
            F.when(take, F.concat(s["out"], F.array(x["chunk_id"]))).otherwise(s["out"]).alias("out"),
            F.when(take, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"),
            x["section"].alias("section"),
            (closed | ~fits).alias("closed"),
            (s["ended"] | (fresh & ~fits)).alias("ended"),
        )

    return F.aggregate(items, start, step)


def fulltext_context(chunks: DataFrame, budget: int, sources: int = 20) -> DataFrame:
    """paper_id, chunk_ids, tokens: usable chunks of each paper in order as far as the budget goes."""
    row = F.struct("chunk_index", F.col("section_type").alias("section"), "chunk_id", token_estimate(F.col("content")).alias("tokens"))
    rows = usable_chunks(chunks).groupBy("paper_id").agg(F.sort_array(F.collect_list(row)).alias("items"))
    rows = rows.withColumn("s", fold_budget(F.col("items"), budget))
    return rows.select("paper_id", F.slice("s.out", 1, sources).alias("chunk_ids"), F.col("s.used").alias("tokens"))


def pack_sources(hits: DataFrame, per: int = 1200, total: int = 4000) -> DataFrame:
    """question_id, no, chunk_id, text: hits in rank order without low value ones, each cut, until the total is used up."""
    rows = drop_low_value(hits).withColumn("text", F.substring(collapse(F.col("content")), 1, per))
    order = Window.partitionBy(Q).orderBy("rank", "chunk_id")
    rows = rows.withColumns({"no": F.row_number().over(order), "upto": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where(F.col("upto") <= total).select(Q, "no", "chunk_id", "text")


def section_sources(summaries: DataFrame, targets: tuple[str, ...], n: int) -> DataFrame:
    """The first ``n`` summaries of each paper in the order of ``targets``; sections not listed come last."""
    place = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("section_type"))
    order = Window.partitionBy("paper_id").orderBy(F.when(place > 0, place).otherwise(len(targets) + 1), "chunk_id")
    return summaries.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def missing_types(papers: DataFrame, wanted: DataFrame, units: DataFrame) -> DataFrame:
    """paper_id, family: wanted families (a short list) without a sure unit. ``units`` has paper_id, family, sure."""
    grid = papers.select("paper_id").crossJoin(F.broadcast(wanted.select("family")))
    return grid.join(units.where("sure").select("paper_id", "family").distinct(), ["paper_id", "family"], "left_anti")


def merge_evidence(structured: DataFrame, retrieved: DataFrame, limit: int) -> DataFrame:
    """question_id, key, pos: structured rows first, the first of each key, up to the limit."""
    both = structured.select(Q, "key", "rank", F.lit(0).alias("origin")).unionByName(retrieved.select(Q, "key", "rank", F.lit(1).alias("origin")))
    firsts = both.groupBy(Q, "key").agg(F.min(F.struct("origin", "rank")).alias("at"))
    pos = F.row_number().over(Window.partitionBy(Q).orderBy("at", "key"))
    return firsts.withColumn("pos", pos).where(F.col("pos") <= limit).select(Q, "key", "pos")


def context_tokens(hits: DataFrame) -> DataFrame:
    return hits.groupBy(Q).agg(F.sum(token_estimate(F.col("content"))).alias("tokens"))


#: Points that a chunk's words earn as evidence for a re-implementation. Fixed values.
CHUNK_POINTS = ((4, ("method", "algorithm", "model")), (3, ("learning rate", "batch", "epoch")), (2, ("loss", "objective", "dataset")), (1, ("experiment", "implementation")))


def chunk_priority(title: Column, content: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, content))
    return sum((F.when(has_any(text, words), points).otherwise(0) for points, words in CHUNK_POINTS), F.lit(0))


def top_chunk_evidence(chunks: DataFrame, n: int = 8, chars: int = 1400) -> DataFrame:
    """The ``n`` chunks of each paper with most points, ties in order, cut."""
    rows = usable_chunks(chunks).withColumn("points", chunk_priority(F.col("section_title"), F.col("content")))
    order = Window.partitionBy("paper_id").orderBy(F.desc("points"), "chunk_index")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n).withColumn("content", F.substring("content", 1, chars))
