"""Streams whose final state equals the batch operators over the same rows.

Keyed state (latest jobs, feedback, windows) is kept by Spark's own state store: the batch operators are aggregations by
key, which run as they are on a stream in update mode, and every batch appends the rows that it changes. What is written
grows with a batch and not with the table. Long-running streams should use the RocksDB store
(``spark.sql.streaming.stateStore.providerClass``), which keeps state on disk.

The full-text index is kept in segments that are only appended; see ``ingest``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import text as X
from paperloom.operators.lexical import postings


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files, with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_timings(spans: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """stage, start, n, total_ms, avg_ms for every window; rows later than ``delay`` are dropped when it runs as a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = spans.withWatermark("ts", delay).groupBy(window.alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"))
    return rows.select("stage", F.col("w.start").alias("start"), "n", F.round("total_ms", 4).alias("total_ms"), F.round(F.col("total_ms") / F.col("n"), 4).alias("avg_ms"))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped as later than the watermark, by its recent progress.

    Spark counts them as they reach the state: rows that a task has put together before count once.
    """
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now to Parquet files and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# --- keyed state


def run_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregation in update mode over what is there now and stop; batch n's changed rows go to ``batch=n``.

    A batch that is repeated overwrites what it wrote.
    """

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_changes(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The newest row of every key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


# --- segments of a full-text index


def _folder(spark: SparkSession, path: str):
    """The file system and path object of ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def segments(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(first batch, last batch, bytes of postings) of the live segments, in order: those that no larger one covers.

    A segment is there once its postings are committed.
    """
    fs, pattern = _folder(spark, f"{path}/postings/first=*/last=*/_SUCCESS")
    found = [tuple(map(int, re.search(r"first=(\d+)/last=(\d+)/", s.getPath().toString()).groups())) for s in fs.globStatus(pattern) or ()]
    live: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda x: (x[0], -x[1])):
        if not live or last > live[-1][1]:
            live.append((first, last))
    return [(a, b, fs.getContentSummary(_folder(spark, f"{path}/postings/first={a}/last={b}")[1]).getLength()) for a, b in live]


def _read(spark: SparkSession, path: str, name: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{name}/first={a}/last={b}" for a, b, _ in parts])


def _newest(papers: DataFrame) -> DataFrame:
    """The row of each paper's newest version; of equal versions the one of the last batch."""
    return papers.groupBy("paper_id").agg(F.max(F.struct("version", "batch")).alias("v")).select("paper_id", "v.version", "v.batch")


def _newest_postings(posts: DataFrame, papers: DataFrame) -> DataFrame:
    """Postings of each paper's newest version. Only papers that came more than once have others, so these few are named."""
    seen = papers.groupBy("paper_id").agg(F.max(F.struct("version", "batch"))["batch"].alias("newest"), F.collect_set("batch").alias("batches"))
    old = seen.where(F.size("batches") > 1).select("paper_id", F.explode("batches").alias("batch"), "newest").where("batch <> newest")
    return posts.join(old.select("paper_id", "batch"), ["paper_id", "batch"], "left_anti")


def _write_segment(path: str, first: int, last: int, papers: DataFrame, posts: DataFrame) -> None:
    papers.write.mode("overwrite").parquet(f"{path}/papers/first={first}/last={last}")
    posts.write.mode("overwrite").parquet(f"{path}/postings/first={first}/last={last}")


#: Bytes of the largest segment that a merge makes.
MERGED_BYTES = 256 << 20


def merged_tail(sizes: list[int], most: int = MERGED_BYTES) -> int:
    """How many of the last segments to merge: from the last on, each that is at most twice as large as those behind it.

    So a posting is written again a number of times that grows with the logarithm of the segments, and not at all once its
    segment is large: beyond ``most`` bytes a merge saves no files worth its writing.
    """
    n, total = 1, sizes[-1]
    while n < len(sizes) and sizes[-n - 1] <= min(2 * total, most - total):
        total += sizes[-n - 1]
        n += 1
    return n


#: Tasks of a batch for each core, as papers differ in size.
BATCH_TASKS = 4


def add_segment(batch: DataFrame, n: int, path: str) -> None:
    """Index batch ``n`` of papers (paper_id, title, text, version) as a segment, and merge the last ones when they are small.

    Texts are cleaned, sectioned and chunked; of a paper that comes twice the newest version counts. A repeated batch is
    written again, or is there already in a merged segment. What a merge replaces is removed after its commit. Texts are
    shuffled once; titles and versions are found without them.
    """
    spark = batch.sparkSession
    if any(a < n <= b for a, b, _ in segments(spark, path)):
        return
    # One more, as files that were parted by the same hash into a multiple or part of this number would leave tasks empty.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), BATCH_TASKS * spark.sparkContext.defaultParallelism) + 1
    newest = lambda *names: F.max_by(F.struct(*names), "version").alias("p")
    texts = batch.repartition(tasks, "paper_id").groupBy("paper_id").agg(newest("text")).select("paper_id", "p.*")
    titles = batch.groupBy("paper_id").agg(newest("title")).select("paper_id", "p.*")
    chunks = X.build_chunks(X.sectionize(X.clean(texts)), titles)
    posts = postings(chunks.withColumn("chunk_id", F.struct("paper_id", "chunk_index"))).select(F.col("chunk_id.paper_id").alias("paper_id"), F.col("chunk_id.chunk_index").alias("chunk_index"), "term", "tf", "doc_len")
    versions = batch.groupBy("paper_id").agg(F.max("version").alias("version"))
    _write_segment(path, n, n, versions.withColumn("batch", F.lit(n)), posts.withColumn("batch", F.lit(n)))
    live = segments(spark, path)
    tail = live[-merged_tail([size for _, _, size in live]) :]
    if len(tail) > 1:
        papers = _read(spark, path, "papers", tail)
        _write_segment(path, tail[0][0], tail[-1][1], _newest(papers), _newest_postings(_read(spark, path, "postings", tail), papers))
        for a, b, _ in tail:
            for name in ("postings", "papers"):
                fs, old = _folder(spark, f"{path}/{name}/first={a}/last={b}")
                fs.delete(old, True)


def ingest(papers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add what is there now of a stream of papers (paper_id, title, text, version) to the index at ``path`` and stop."""
    query = papers.writeStream.foreachBatch(lambda batch, n: add_segment(batch, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, chunk_index, term, tf, doc_len of every paper's newest version."""
    live = segments(spark, path)
    return _newest_postings(_read(spark, path, "postings", live), _read(spark, path, "papers", live)).drop("batch")
