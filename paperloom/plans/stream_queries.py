"""Registered queries that run as streams (M); each oracle is the batch result.

Each writes its table to several files first, so that the stream has several batches and its state is folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import dialogue, knowledge
from paperloom.plans.catalog import ORACLES, query
from paperloom.plans.search_queries import tokens_sql
from paperloom.plans.views_sql import over
from paperloom.sources import views as V
from paperloom.sources.scratch import shared_folder
from paperloom.streaming import jobs as S

FILES = 3


def _stream(spark: SparkSession, sf_dir: str, name: str, order: str, root: str) -> DataFrame:
    V.table(spark, sf_dir, name).repartitionByRange(FILES, order).write.parquet(f"{root}/in/{name}")
    return S.stream_table(spark, f"{root}/in/{name}/*.parquet")


@query(over("SELECT paper_id, job_id, status FROM last_jobs", "last_jobs"))
def m3_stream_latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    events = _stream(spark, sf_dir, "events", "event_id", root)
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    rows = events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("paper_id"), status.alias("status"), F.col("ts").alias("create_time"), F.lit(0).cast("long").alias("processed"), F.lit(20).cast("long").alias("total"))
    S.run_changes(dialogue.latest_jobs(rows), f"{root}/out", f"{root}/checkpoint")
    return S.read_changes(spark, f"{root}/out", ("paper_id",)).select("paper_id", "job_id", "status")


@query(
    over(
        f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT paper_id, section_index, part, term, count(*) AS tf FROM (SELECT paper_id, section_index, part, unnest({tokens_sql('chunk')}) AS term FROM cut_chunks WHERE chunk <> '') GROUP BY ALL) GROUP BY 1",
        "cut_chunks",
    )
)
def m1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as they come, a seventh of them as drafts first; cleaned, chunked and indexed in segments.

    All tasks write files; as many make a batch that there are about as many batches as ``FILES``.
    """
    root = shared_folder(spark)
    papers = V.papers(spark, sf_dir)
    drafts = papers.where("paper_id % 7 = 0").withColumn("text", F.concat(F.lit("Abstract\nDraft of what comes later on. "), F.substring("text", 1, 500)))
    drafts.withColumn("version", F.lit(1)).coalesce(FILES).write.parquet(f"{root}/in/papers")
    papers.withColumn("version", F.lit(2)).write.mode("append").parquet(f"{root}/in/papers")
    files = len(spark.read.parquet(f"{root}/in/papers").inputFiles())
    S.ingest(S.stream_table(spark, f"{root}/in/papers/*.parquet", -(-files // FILES)), f"{root}/out", f"{root}/checkpoint")
    return S.read_postings(spark, f"{root}/out").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(ORACLES["i10_apply_feedback"])
def m2_stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark)
    events = _stream(spark, sf_dir, "events", "event_id", root)
    action = F.when(F.col("event_type") == "purchase", "CONFIRM").when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "signup", "CORRECT")
    value = F.when(F.col("event_type") == "signup", F.concat(F.lit("v"), "event_id"))
    rows = events.select("event_id", F.col("user_id").alias("unit_id"), action.alias("action"), value.alias("object_value"), "ts").where("action IS NOT NULL")
    S.run_changes(knowledge.apply_feedback(rows), f"{root}/out", f"{root}/checkpoint")
    return S.read_changes(spark, f"{root}/out", ("unit_id",))


def _timings(spark: SparkSession, sf_dir: str, width: str, slide: str | None) -> DataFrame:
    """Windows as they stand at the end. The delay is beyond all disorder of the files, so no row is dropped."""
    root = shared_folder(spark)
    events = _stream(spark, sf_dir, "events", "ts", root)
    rows = events.select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), F.col("ts").cast("timestamp").alias("ts"))
    done = S.run_changes(S.windowed_timings(rows, width, slide, "40 days"), f"{root}/out", f"{root}/checkpoint")
    out = S.read_changes(spark, f"{root}/out", ("stage", "start"))
    return out.select("stage", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total_ms", 2).alias("total_ms"), F.round("avg_ms", 2).alias("avg_ms"), F.lit(S.dropped_rows(done)).cast("long").alias("dropped"))


_TOLD = "count(*) AS n, round(sum(ms), 2) AS total_ms, round(round(avg(ms), 4), 2) AS avg_ms, CAST(0 AS BIGINT) AS dropped"


@query(over(f"SELECT stage, time_bucket(INTERVAL 1 DAY, ts) AS start, {_TOLD} FROM spans GROUP BY 1, 2", "spans"))
def m4_windowed_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timings(spark, sf_dir, "1 day", None)


@query(over(f"SELECT stage, time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * back AS start, {_TOLD} FROM spans, (SELECT unnest([0, 1, 2]) AS back) GROUP BY 1, 2", "spans"))
def m4_sliding_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days, one of them beginning every day."""
    return _timings(spark, sf_dir, "3 days", "1 day")
