r"""Byte-level BPE encoding and decoding (operator 5) by overlapping chunks.

Texts of at most ``chunk`` code points are encoded where they lie. Longer ones are cut into chunks of ``chunk`` code
points, each with ``overlap`` more of the next. Every chunk is pre-tokenised by itself, in parallel, and tells where
pre-tokens begin near its two ends. Two neighbours are stitched at the first place in their overlap where both begin a
pre-token: from a common boundary on, both see the same text and so agree. A boundary is trusted only if it lies
``MARGIN`` or more before the end of a cut chunk, as the pattern looks ahead. Between its two stitches a chunk's
pre-tokens are those of the whole text; they are encoded by the ranks. A document with a pair of chunks that never
resynchronises (one pre-token longer than the overlap) is put together again and encoded whole.

Decoding concatenates the ranks' bytes, so it gives back the UTF-8 bytes of the text exactly.

Null counts as empty; an empty text has no ids. Repeated rows are encoded each for itself. An empty table gives an
empty result. Other columns are kept if listed as keys. A long document's chunks are spread over tasks and only their
boundaries and ids are gathered by document. Long rows are written once, as numbers tie their chunks to them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, released, slices

MARGIN = 8
#: Pre-tokens remembered with their ids in each worker.
CACHE = 200_000
#: A vocabulary file may have so many bytes to be sent to every worker.
MAX_VOCABULARY = 64_000_000


@dataclass(frozen=True)
class BpeParams:
    chunk: int = 32_768
    overlap: int = 1_024


class Codec:
    """One worker's encoder for a vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def whole(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def pieces(self, pieces: Sequence[str]) -> list[int]:
        """The ids of pre-tokens."""
        known = self.known
        for x in pieces:
            if x not in known:
                if len(known) >= CACHE:
                    known.clear()
                    return list(chain.from_iterable(self.encoding._encode_single_piece(y) for y in pieces))
                known[x] = self.encoding._encode_single_piece(x)
        return list(chain.from_iterable(known[x] for x in pieces))


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


class Vocabulary:
    """A rank file of tiktoken's form and its pattern, read once on the driver and sent to the workers."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = f.read()
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"{path}: {len(ranks)} bytes; {MAX_VOCABULARY} at most")
        self.sent, self.pattern = spark.sparkContext.broadcast(ranks), pattern

    def codec(self) -> Codec:
        return _codec(self.sent.value, self.pattern)


def _list(rows: list[np.ndarray | None]) -> pa.Array:
    edges = np.cumsum([0, *(0 if x is None else len(x) for x in rows)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *(x for x in rows if x is not None)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values), mask=pa.array([x is None for x in rows], pa.bool_()))


def _with_ids(codec: Codec, keys: pa.RecordBatch, ids: list[np.ndarray], decoded: str | None) -> pa.RecordBatch:
    columns, names = [*keys.columns, _list(ids)], [*keys.schema.names, "ids"]
    if decoded:
        columns.append(pa.array([codec.encoding.decode_bytes(x.tolist()) for x in ids], pa.binary()))
        names.append(decoded)
    return pa.RecordBatch.from_arrays(columns, names)


def _whole(vocabulary: Vocabulary, decoded: str | None):
    """Encodes the last column; the others stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for part in slices(batches, 100):
            keys = part.select(part.schema.names[:-1])
            yield _with_ids(codec, keys, [codec.whole(t) for t in part.column(part.num_columns - 1).to_pylist()], decoded)

    return rows


def _rejoined(vocabulary: Vocabulary, decoded: str | None):
    """(row, ids of all chunks, text of a broken document) to (row, ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for part in slices(batches, 10):
            ids = []
            for flat, raw in zip(part.column(1), part.column(2), strict=True):
                text = raw.as_py()
                ids.append(codec.whole(text) if text else flat.values.to_numpy())
            yield _with_ids(codec, part.select(["_row"]), ids, decoded)

    return rows


def _cut(p: BpeParams):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                starts = list(range(0, len(t), p.chunk))
                pieces = [t[s : s + p.chunk + p.overlap] for s in starts]
                last = [s + p.chunk + p.overlap >= len(t) for s in starts]
                if any(last[:-1]):  # a chunk reaches the end: those after it are not needed
                    n = last.index(True) + 1
                    starts, pieces, last = starts[:n], pieces[:n], last[:n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array(starts, pa.int32()), pa.array(pieces, pa.string()), pa.array(last, pa.bool_())],
                    ["_row", "_chunk", "_start", "_piece", "_last"],
                )

    return rows


def _edges(vocabulary: Vocabulary, p: BpeParams):
    """Adds where pre-tokens begin in the overlap with the chunk before and with the chunk after."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.codec().pattern.finditer
        for batch in batches:
            left, right = [], []
            for start, piece, last in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                begins = [m.start() for m in find(piece)]
                sure = len(piece) if last else len(piece) - MARGIN
                left.append([start + b for b in begins if b < min(p.overlap, sure)])
                right.append([start + b for b in begins if p.chunk <= b < sure])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, kind), pa.array(right, kind)], [*batch.schema.names, "_left", "_right"])

    return rows


def _encode_chunks(vocabulary: Vocabulary, p: BpeParams):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for part in slices(batches, 20):
            ids, raw = [], []
            columns = [part.column(c).to_pylist() for c in ("_start", "_piece", "_last", "_from", "_to", "_broken")]
            for start, piece, last, begin, end, broken in zip(*columns, strict=True):
                if broken:
                    ids.append(None)
                    raw.append(piece if last else piece[: p.chunk])
                    continue
                stop = len(piece) if end is None else end - start
                pieces = []
                for m in codec.pattern.finditer(piece, begin - start):
                    if m.start() >= stop:
                        break
                    pieces.append(m[0])
                ids.append(np.array(codec.pieces(pieces), np.int32))
                raw.append(None)
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_chunk"), _list(ids), pa.array(raw, pa.string())], ["_row", "_chunk", "_ids", "_raw"])

    return rows


def encode(
    docs: DataFrame, vocabulary: Vocabulary, keys: Sequence[str] = ("doc_id",), text: str = "text", params: BpeParams | None = None, decoded: str | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """``keys`` and ``ids`` (array<int>) for every row of ``docs``.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name; see ``decode``.
    """
    p = params or BpeParams()
    if p.overlap > p.chunk // 2 or p.overlap <= MARGIN:
        raise ValueError("the overlap must be over MARGIN and at most half a chunk")
    rows = docs.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    results = ["ids array<int>", *[f"`{decoded}` binary"] * bool(decoded)]
    kept = [f"_key{i} {rows.schema[f'_key{i}'].dataType.simpleString()}" for i in range(len(keys))]
    out = [*names, "ids", *[decoded] * bool(decoded)]

    short = rows.where(F.length("_text") <= p.chunk).mapInArrow(released(_whole(vocabulary, decoded)), ", ".join([*kept, *results])).select(*out)
    long = rows.where(F.length("_text") > p.chunk).withColumn("_row", F.monotonically_increasing_id())
    long = (scratch or Scratch(docs.sparkSession)).write(long, "long")  # read twice, under one number
    chunks = long.select("_row", "_text").mapInArrow(released(_cut(p)), "_row long, _chunk int, _start int, _piece string, _last boolean")
    chunks = chunks.repartition("_row", "_chunk").mapInArrow(released(_edges(vocabulary, p)), "_row long, _chunk int, _start int, _piece string, _last boolean, _left array<int>, _right array<int>")
    order = Window.partitionBy("_row").orderBy("_chunk")
    common = F.array_min(F.array_intersect(F.lag("_right").over(order), F.col("_left")))
    chunks = chunks.withColumn("_from", F.when(F.col("_chunk") == 0, F.lit(0)).otherwise(common)).drop("_left", "_right")
    chunks = chunks.withColumns({"_to": F.lead("_from").over(order), "_broken": F.max(F.col("_from").isNull()).over(Window.partitionBy("_row"))})
    parts = chunks.repartition("_row", "_chunk").mapInArrow(released(_encode_chunks(vocabulary, p)), "_row long, _chunk int, _ids array<int>, _raw string")
    parts = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_ids", "_raw"))).alias("_parts"))
    empty = F.array().cast("array<int>")
    flat = F.flatten(F.transform("_parts", lambda x: F.coalesce(x["_ids"], empty)))
    encoded = parts.select("_row", flat.alias("_ids"), F.array_join("_parts._raw", "").alias("_raw"))
    encoded = encoded.mapInArrow(released(_rejoined(vocabulary, decoded)), ", ".join(["_row long", *results]))
    return short.unionByName(long.drop("_text").join(encoded, "_row").select(*out))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the bytes of the ids; null ids count as none."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = vocabulary.codec().encoding
        for rows in batches:
            yield pa.array([encoding.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in rows], pa.binary())

    return encoded.withColumn(into, joined(F.col(ids)))
