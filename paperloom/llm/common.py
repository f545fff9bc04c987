"""Helpers shared by the operators of this folder: shared scratch tables and joins with a checked broadcast."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a table of keys may have, as rows in memory, to be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a session on one machine gets a temporary folder; on a cluster that is an error, as
    executors could not read what others wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables of one operator call in the shared folder. They cut lineage and survive lost executors.

    An operator drops its larger tables when no later step reads them. The rest is read by the frame that it returns,
    so a caller that wants them gone passes its own ``Scratch`` and calls ``drop()`` when the result is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = scratch_dir(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without names, all."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_bytes(table: DataFrame) -> int:
    """About the bytes that the rows of a table of plain columns take in memory, by counting them."""
    wide = [F.octet_length(f.name) for f in table.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    wide += [8 * F.size(f.name) for f in table.schema.fields if f.dataType.simpleString() in ("array<int>", "array<bigint>")]
    told = table.agg(F.count("*").alias("n"), *[F.sum(x).alias(f"w{i}") for i, x in enumerate(wide)]).first()
    return told[0] * (24 + 8 * len(table.columns)) + sum(x or 0 for x in told[1:])


def key_join(big: DataFrame, keys: DataFrame, on, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with ``keys``, broadcasting ``keys`` only after measuring that it has ``limit`` bytes at most.

    ``keys`` should be a written table of plain columns: it is counted here. A larger table is joined by shuffle.
    """
    if table_bytes(keys) <= limit:
        keys = F.broadcast(keys)
    out = big.join(keys, on, how)
    return out.select(*big.columns) if how in ("left_semi", "left_anti") else out


def patched(rows: DataFrame, patches: DataFrame, key: str, change, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` where those with a row in ``patches`` (unique by ``key``) are joined with it and changed.

    ``change`` gets the joined rows; the others get its new columns as nulls. Only rows that change are shuffled.
    """
    patches = scratch.write(patches, name)
    keys = scratch.write(patches.select(key), f"{name}_keys")
    changed = change(key_join(rows, keys, key, "left_semi").join(patches, key))
    rest = key_join(rows, keys, key, "left_anti")
    return rest.unionByName(changed.select(*rows.columns, *[c for c in changed.columns if c not in rows.columns]), allowMissingColumns=True)


def row_key(*cols: str) -> Column:
    """A 128-bit key of a row's values; equal rows share it. Nulls and empty strings differ."""
    texts = [F.col(c).cast("string") for c in cols]
    sizes = [F.coalesce(F.length(t), F.lit(-1)).cast("string") for t in texts]
    return F.unhex(F.md5(F.concat_ws(" ", *sizes, *texts).cast("binary")))


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, rid, text): the caller's whole row as one struct beside its id, row key and text.

    Operators that hand rows on work on this form, so the caller's columns cannot clash with theirs.
    """
    return docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), row_key(key, text).alias("rid"), F.col(text).alias("text"))


def unpacked(rows: DataFrame, columns: list[str], *added: str, **replaced: Column) -> DataFrame:
    """Back from ``packed``: the caller's ``columns``, some replaced, and the operator's; a caller's column named like
    one of ``added`` gives way to it."""
    own = {c.lower() for c in added}
    kept = [c for c in columns if c.lower() not in own]
    return rows.select(*[(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in kept], *added)


def hot_join(big: DataFrame, keys: DataFrame, on: list[str], count: str, hot: int = 1000) -> DataFrame:
    """``big`` joined with the written table ``keys``, unique by ``on``, whose ``count`` says how many rows each key meets.

    The keys with most rows, of more than ``hot`` rows and as many as ``BROADCAST_BYTES`` hold, are broadcast, so that no
    task gets all rows of one key. The rest is joined by shuffle: each of these keys has fewer rows than any that was
    broadcast, and so at most the rows of ``big`` divided by the number of those.
    """
    level = F.floor(F.log2(F.col(count)))
    top = keys.where(F.col(count) > hot)
    row = table_bytes(top) / max(top.count(), 1)
    least, held = None, 0
    for r in top.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows at most
        held += r["count"]
        if held * row > BROADCAST_BYTES:
            break
        least = max(hot + 1, 1 << int(r["level"]))
    if least is None:
        return big.join(keys.hint("merge"), on)
    top = keys.where(F.col(count) >= least)
    often = big.join(F.broadcast(top), on)
    return often.unionByName(big.join(F.broadcast(top.select(*on)), on, "left_anti").join(keys.where(F.col(count) < least).hint("merge"), on))


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches in pieces of ``rows`` rows, to bound what Python objects are made of at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return freed memory of a Python worker, which is kept for later tasks, to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def released(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives freed memory back when its partition is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While jobs run inside, Arrow batches have ``rows`` rows at most, to bound the memory of Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
