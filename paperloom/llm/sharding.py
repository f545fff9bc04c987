"""Sharding (operator 7): contiguous shards of near equal bytes from global prefix sums of sizes.

Rows are put in key order by a range partitioning. Each partition's total size is one row of a small table (as many
rows as partitions); its running sum gives every partition its start, and a window inside the partition gives every row
its own. A row goes to the shard in whose target, an equal part of the total, the middle of the row lies; so shards are
contiguous in key order and their sizes differ from the target by about one row at most.

A row's size is the UTF-8 bytes of its text (null: none) plus 8. Rows with equal keys are ordered by the text's
checksum; equal rows are interchangeable and are spread over partitions by a salt, so that one key with a large part of
all rows makes no hot partition. A null key comes first. An empty table gives an empty result. A row larger than a
target leaves the shards that it spans empty but one. All work is done by built-in expressions; the narrow table of
keys and sizes is written to the shared folder, as the partitioning must be the same for the totals and the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch

ROWS_PER_PARTITION = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``key``, size, text_crc32, shard and slot for every row of ``docs``; slots count from 0 inside a shard."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    binary = F.encode(F.col(text), "utf-8")
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(binary), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(4096)).alias("_salt"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_PARTITION), 1)
    ranged = rows.repartitionByRange(parts, "_key", "text_crc32", "_salt").withColumn("_part", F.spark_partition_id())
    ranged = scratch.write(ranged, "shard_rows")

    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"))  # a row for each partition
    starts = totals.select("_part", F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_start"))
    total = totals.agg(F.sum("_bytes").alias("_total"))

    inside = Window.partitionBy("_part").orderBy("_key", "text_crc32", "_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"_end": F.sum("size").over(inside), "_n": F.row_number().over(inside)})
    placed = placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(total))
    # Twice the middle of the row, as a whole number; decimals keep the product exact.
    middle = (2 * (F.col("_start") + F.col("_end")) - F.col("size")).cast("decimal(38,0)")
    shard = F.floor(middle * shards / (2 * F.col("_total")).cast("decimal(38,0)")).cast("int")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))

    # Slots: rows of the shard in earlier partitions, plus the row's place among its own partition's rows of the shard.
    counts = placed.groupBy("_part", "shard").agg(F.count("*").alias("_rows"), F.min("_n").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "shard", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    placed = placed.join(F.broadcast(counts), ["_part", "shard"])
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_base") + F.col("_n") - F.col("_first")).cast("long").alias("slot"))
