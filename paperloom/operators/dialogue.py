"""Conversations, model-output tables, writing projects and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import collapse, occurrences, trim_all

S, M = "session_id", "msg_id"


def recent_messages(msgs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session with their place from the oldest kept, and whether there are more."""
    newest = F.row_number().over(Window.partitionBy(S).orderBy(F.desc(M)))
    total = F.count("*").over(Window.partitionBy(S))
    rows = msgs.withColumns({"_back": newest, "has_more": total > n}).where(F.col("_back") <= n)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(S).orderBy(M))).drop("_back")


def pair_turns(msgs: DataFrame) -> DataFrame:
    """session_id, msg_id, question, answer: a user message right before an assistant's, neither blank."""
    order = Window.partitionBy(S).orderBy(M)
    rows = msgs.select(S, M, "role", "content", F.lead("role").over(order).alias("next"), F.lead("content").over(order).alias("answer"))
    full = lambda c: F.coalesce(trim_all(F.col(c)), F.lit("")) != ""
    rows = rows.where((F.col("role") == "user") & (F.col("next") == "assistant") & full("content") & full("answer"))
    return rows.select(S, M, F.col("content").alias("question"), "answer")


def fit_history(turns: DataFrame, budget: int, overhead: int = 32) -> DataFrame:
    """session_id, kept, omitted, used, too_small: newest turns first as long as their bytes fit."""
    size = (F.octet_length("question") + F.octet_length("answer") + 2 * overhead).cast("long")
    order = Window.partitionBy(S).orderBy(F.desc(M)).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("size", size).withColumn("total", F.sum("size").over(order))
    fits = F.col("total") <= budget
    return rows.groupBy(S).agg(
        F.count_if(fits).alias("kept"), F.count_if(~fits).alias("omitted"), F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0)).alias("used"), (F.count_if(fits) == 0).alias("too_small")
    )


def history_snippet(msgs: DataFrame, n: int = 6, chars: int = 500) -> DataFrame:
    """session_id, snippet: the last messages, labelled, white space collapsed, cut, one a line."""
    line = F.concat("role", F.lit(": "), F.substring(collapse(F.coalesce("content", F.lit(""))), 1, chars))
    rows = recent_messages(msgs, n).select(S, F.struct("pos", line.alias("line")).alias("r"))
    return rows.groupBy(S).agg(F.sort_array(F.collect_list("r")).alias("rs")).select(S, F.array_join("rs.line", "\n").alias("snippet"))


def sessions(msgs: DataFrame, chars: int = 30) -> DataFrame:
    """session_id, title (the first user message, cut), last message, messages."""
    first = F.min_by(F.when(F.col("role") == "user", F.substring(F.coalesce("content", F.lit("")), 1, chars)), F.when(F.col("role") == "user", F.col(M)))
    return msgs.groupBy(S).agg(first.alias("title"), F.max(M).alias("last"), F.count("*").alias("messages"))


def clean_rewrite(text: Column, chars: int = 400) -> Column:
    """A model's rewritten question without fences, labels and quotes."""
    t = F.regexp_replace(trim_all(F.coalesce(text, F.lit(""))), r"^```[a-z]*\n?|```$", "")
    t = F.regexp_replace(trim_all(t), r"(?i)^(question|query|rewrite)\s*[:：]\s*", "")
    return F.substring(F.regexp_replace(trim_all(t), "^[\"'“”]+|[\"'“”]+$", ""), 1, chars)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The last job of each paper by time, then id."""
    return jobs.groupBy("paper_id").agg(F.max_by(F.struct("job_id", "status", "processed", "total"), F.struct("create_time", "job_id")).alias("j")).select("paper_id", "j.*")


def job_progress(jobs: DataFrame) -> DataFrame:
    """Percent done (5 at first, 80 when all sections are) and the retries before each job of a paper."""
    order = Window.partitionBy("paper_id").orderBy("create_time", "job_id")
    percent = F.when(F.col("total") > 0, 5 + F.floor(75 * F.col("processed") / F.col("total"))).otherwise(5)
    return jobs.select("job_id", "paper_id", percent.cast("long").alias("percent"), (F.row_number().over(order) - 1).cast("long").alias("retries"))


def batch_outcome(items: DataFrame, key: str) -> DataFrame:
    failed, done = F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status") != "FAILED")
    status = F.when(F.col("failed") == 0, "COMPLETED").when(F.col("done") > 0, "PARTIAL_SUCCESS").otherwise("FAILED")
    return items.groupBy(key).agg(failed.alias("failed"), done.alias("done")).withColumn("outcome", status)


# --- writing

CITATION = r"\[P(\d+)\]"


def citations(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """key, pos, paper_id of every [P<id>] mark in order."""
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(CITATION), F.lit(1))).alias("pos", "id"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.expr("try_cast(id AS bigint)").alias("paper_id"))


def audit_citations(docs: DataFrame, allowed: DataFrame, key: str, text: str = "content", least: int = 40) -> DataFrame:
    """key, valid, invalid, papers, paragraphs, coverage, uncited, warned: marks by whether the paper is allowed, and cited paragraphs.

    ``uncited`` lists the allowed papers that no mark names; places where a source is missing count as invalid marks, and
    ``warned`` says that there are some.
    """
    marks = citations(docs, key, text).join(allowed.select(key, "paper_id", F.lit(True).alias("ok")), [key, "paper_id"], "left")
    counts = marks.groupBy(key).agg(F.count_if("ok").alias("valid"), F.count_if(F.col("ok").isNull()).alias("invalid"), F.count_distinct(F.when(F.col("ok"), F.col("paper_id"))).alias("papers"))
    left = allowed.select(key, "paper_id").join(marks.select(key, "paper_id").distinct(), [key, "paper_id"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("paper_id")).alias("uncited"))
    paragraphs = F.filter(F.split(F.col(text), r"\n\s*\n"), lambda x: (F.length(trim_all(x)) >= least) & ~trim_all(x).startswith("#"))
    missing = occurrences(F.col(text), rules.MISSING_SOURCE)
    shares = docs.select(key, missing.alias("missing"), F.size(paragraphs).alias("paragraphs"), F.size(F.filter(paragraphs, lambda x: x.rlike(CITATION))).alias("cited"))
    out = shares.join(counts, key, "left").join(left, key, "left").na.fill(0, ["valid", "invalid", "papers"])
    coverage = F.when(F.col("paragraphs") > 0, F.round(100.0 * F.col("cited") / F.col("paragraphs"), 1)).otherwise(0.0)
    none = F.array().cast("array<bigint>")
    return out.select(key, "valid", (F.col("invalid") + F.col("missing")).alias("invalid"), "papers", F.col("paragraphs").cast("long").alias("paragraphs"), coverage.alias("coverage"), F.coalesce("uncited", none).alias("uncited"), (F.col("missing") > 0).alias("warned"))


def word_count(text: Column) -> Column:
    """Han characters and Latin words."""
    return (F.regexp_count(text, F.lit(r"\p{IsHan}")) + F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"))).cast("long")


# --- telemetry


def timing_rollup(spans: DataFrame, stages: tuple[str, ...], total: str) -> DataFrame:
    """request_id, one sum for each stage, total_ms, other_ms, dominant stage; repeated stages add up."""
    sums = spans.groupBy("request_id").pivot("stage", [*stages, total]).agg(F.sum("ms"))
    of = lambda s: F.round(F.coalesce(F.col(s), F.lit(0.0)), 4)
    known = sum((of(s) for s in stages[1:]), of(stages[0]))
    rows = sums.select("request_id", *[of(s).alias(s) for s in stages], F.round(F.greatest(of(total), known), 4).alias("total_ms"), known.alias("_known"))
    top = F.greatest(*[F.col(s) for s in stages])
    dominant = None
    for s in stages:
        dominant = F.when(F.col(s) == top, s) if dominant is None else dominant.when(F.col(s) == top, s)
    return rows.withColumns({"other_ms": F.round(F.col("total_ms") - F.col("_known"), 4), "dominant": dominant}).drop("_known")


def timing_shares(rollup: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """request_id, stage, ms, percent of the total (one decimal), stages with time only."""
    rows = rollup.unpivot(["request_id", "total_ms"], list(stages), "stage", "ms").where("ms > 0")
    return rows.select("request_id", "stage", "ms", F.round(100 * F.col("ms") / F.col("total_ms"), 1).alias("percent"))


def latency_stats(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.round(F.avg(value), 4).alias("avg_ms"), F.round(F.percentile(value, F.lit(0.95)), 4).alias("p95_ms"))


def latency_sketches(runs: DataFrame, by: str, part: Column, value: str) -> DataFrame:
    """``by``, part, runs, total, sketch: a quantile sketch for each group and part, such as a day, to be kept."""
    return runs.groupBy(by, part.alias("part")).agg(F.count(value).alias("runs"), F.sum(value).alias("total"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def sketched_stats(sketches: DataFrame, by: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """``by``, runs, avg_ms and estimated quantiles (p50_ms, ...) from sketches of any parts, merged; no value is read again.

    A quantile's rank is off by 1.7 % at most, nearly always.
    """
    whole = sketches.groupBy(by).agg(F.sum("runs").alias("runs"), (F.sum("total") / F.sum("runs")).alias("avg_ms"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(by, "runs", "avg_ms", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(100 * q)}_ms") for q in quantiles])


def retrieval_metrics(found: DataFrame, gold: DataFrame, key: str = "question_id", item: str = "chunk_id") -> DataFrame:
    """question_id, recall, precision of each question with gold items; questions without a result count as nothing found."""
    right = found.select(key, item).distinct().join(gold.select(key, item).distinct(), [key, item]).groupBy(key).agg(F.count("*").alias("hit"))
    wanted = gold.select(key, item).distinct().groupBy(key).agg(F.count("*").alias("gold"))
    got = found.select(key, item).distinct().groupBy(key).agg(F.count("*").alias("found"))
    rows = wanted.join(got, key, "left").join(right, key, "left")
    hit = F.coalesce("hit", F.lit(0))
    return rows.select(key, F.round(hit / F.col("gold"), 6).alias("recall"), F.round(F.when(F.col("found") > 0, hit / F.col("found")).otherwise(0.0), 6).alias("precision"))


def metric_gates(metrics: DataFrame) -> DataFrame:
    """metric, delta (two decimals), passed: no target, or reached."""
    return metrics.select("metric", F.round(F.col("final") - F.col("baseline"), 2).alias("delta"), (F.col("target").isNull() | (F.col("final") >= F.col("target"))).alias("passed"))
