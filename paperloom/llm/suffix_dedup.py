r"""Suffix-array dedup (operator 13): bytes that lie in a string of ``width`` bytes which also starts anywhere else go.

A window is a string of ``width`` bytes inside one document. A window is repeated if an equal one starts at another place
of the corpus, in the same document or in another one. All bytes of repeated windows are removed; windows are judged on
the input and may overlap. In a suffix array these are the suffixes that agree with a neighbour in ``width`` bytes. The
array is built by buckets over a difference cover, so that no task ever holds more than one bucket:

1. Texts. One row for every distinct text of ``width`` bytes or more; a text that stands in two rows goes whole. Long texts
   are cut into pieces so that every window lies in exactly one of them.
2. Cover sample. The places whose number modulo the period lies in a perfect difference set are its cover: any two places
   meet cover points at a common distance below the period. So two equal windows share a cover point followed by
   ``width - period + 1`` equal bytes. Every cover point gets a rank by two names, of so many bytes and of
   ``width + period - 1`` (or up to the end of the text); ranks are shuffled to their buckets and sorted there, one bucket
   at a time.
3. What ranks settle. Windows without a cover point of a repeated short name within a period behind them are unique. Equal
   long names are long ties: all windows that begin within a period behind such points are repeated. Only the first
   point of each long name stays in the array to stand for its windows; the others need no comparison. Every window
   that is left out equals one at an earlier place, so the chain ends at a window in the array.
4. Suffix buckets. The windows left are sorted by name, one bucket at a time; two of one name are repeated.

Names are fingerprints: in its bucket a rank has 64 bits, so 64 bits and those of the bucket must agree by chance to make a
mistake; the order inside a bucket is that of names, as only equality is asked for. What one batch of texts repeats in
itself is settled there: a batch sends each name to its bucket once, however often it has it, so a passage that a third
of all texts share gives its bucket one row for each batch. Numbers of buckets follow the bytes.

Null and short texts come back whole. Repeated rows are places like others, so their texts go whole. Documents are never
cut at character borders: what is left is binary. Extra columns stay, whatever their names; only columns named kept,
removed_spans and n_bytes are replaced. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, give_back, key_join, released, unpacked
from paperloom.llm.hashing import _BYTE, groups, range_hashes

#: Perfect difference sets by period, as Singer's rule gives them: fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 133: (0, 1, 3, 17, 21, 58, 65, 73, 100, 105, 111, 124)}
#: Bytes of texts that a task gathers before it sends their names, and of the longest piece of a text.
BATCH, PIECE = 4 << 20, 1 << 20
#: Names that one bucket should hold, and the largest number of buckets.
BUCKET_NAMES, MAX_BUCKETS = 250_000, 1 << 16
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: What is known of a name: it is there twice; its whole rank is; an earlier place has the rank.
_SEEN, _TIED, _LATER = 1, 2, 4


@dataclass(frozen=True)
class Cover:
    width: int
    period: int
    residues: tuple[int, ...]

    @property
    def short(self) -> int:
        return self.width - self.period + 1

    @property
    def long(self) -> int:
        return self.width + self.period - 1

    def points(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the cover points of texts of ``sizes`` bytes that a short name follows."""
        rounds = np.arange(int(sizes.max(initial=0)) // self.period + 1) * self.period
        every = (rounds[:, None] + np.array(self.residues)).reshape(-1)
        counts = np.searchsorted(every, sizes - self.short, "right")
        text = np.repeat(np.arange(len(sizes)), counts)
        return text, every[np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)]


def cover_of(width: int) -> Cover:
    """The cover with the longest period that leaves short names of a third of the width."""
    fits = [p for p in COVERS if 3 * p <= 2 * width]
    if not fits:
        raise ValueError(f"width {width}: {3 * min(COVERS) // 2 + 1} at least")
    return Cover(width, max(fits), COVERS[max(fits)])


# --- names to buckets and back

_SENT = "bucket int, batch long, ranks binary, places binary, docs binary, sizes binary, local binary, flags binary"
_TOLD = "batch long, docs binary, sizes binary, places binary, flags binary"


def _sent(batch: int, docs: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The names of a batch of texts by bucket, each once, and a row that describes the batch."""
    order = np.argsort(ranks, kind="stable")
    same = np.concatenate([[False], (np.diff(ranks[order]) == 0) & (np.diff(bucket[order]) == 0)]) if len(order) else np.empty(0, bool)
    flags = np.zeros(len(ranks), np.uint8)
    flags[order[same]] = _SEEN | _TIED | _LATER
    flags[order[np.flatnonzero(same & ~np.concatenate([[False], same[:-1]])) - 1]] |= _SEEN | _TIED
    local = np.flatnonzero(flags)
    once = np.sort(order[~same])
    once = once[np.argsort(bucket[once], kind="stable")]
    found, begins = np.unique(bucket[once], return_index=True)
    rows: list[tuple] = []
    for b, part in zip(found.tolist(), np.split(once, begins[1:]), strict=False):
        gaps = np.diff(part, prepend=0)
        rows.append((b, batch, ranks[part].tobytes(), gaps.astype("<u2" if gaps.max() < 1 << 16 else "<u4").tobytes(), None, None, None, None))
    rows.append((batch % buckets, batch, None, None, docs.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), local.astype("<u4").tobytes(), flags[local].tobytes()))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = ["bucket", "batch", "ranks", "places", "docs", "sizes", "local", "flags"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Sorts the ranks of one bucket and tells every batch which of its names are met again."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    out = [(r["batch"], r["docs"], r["sizes"], r["local"], r["flags"]) for r in rows if r["ranks"] is None]
    rows = [r for r in rows if r["ranks"] is not None]
    if rows:
        ranks = [np.frombuffer(r["ranks"], "<u8") for r in rows]
        places = [np.cumsum(np.frombuffer(r["places"], "<u2" if len(r["places"]) * 4 == len(r["ranks"]) else "<u4"), dtype=np.uint32) for r in rows]
        edges = np.cumsum([0, *map(len, ranks)])
        rank = np.concatenate(ranks)
        order = np.argsort(rank, kind="stable")  # batches and places ascend, so the first of a run is the first of the corpus
        rank = rank[order]
        flags = np.zeros(len(rank), np.uint8)
        for value, flag in ((rank >> np.uint64(32), _SEEN), (rank, _TIED)):
            same = value[1:] == value[:-1]
            flags[1:][same] |= flag | (_LATER if flag == _TIED else 0)
            flags[:-1][same] |= flag
        back = np.empty_like(flags)
        back[order] = flags
        for r, at, lo, hi in zip(rows, places, edges[:-1], edges[1:], strict=True):
            hit = np.flatnonzero(back[lo:hi])
            if len(hit):
                out.append((r["batch"], None, None, at[hit].tobytes(), back[lo:hi][hit].tobytes()))
    kinds = [pa.int64(), *[pa.binary()] * 4]
    columns = zip(*out) if out else [()] * 5
    give_back()
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("batch", "docs", "sizes", "places", "flags"), columns, kinds, strict=True)})


def _of_batch(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """(docs, sizes, flags of n names) of a batch from what its buckets told."""
    rows = table.to_pylist()
    heads = [r for r in rows if r["docs"] is not None]
    if len(heads) != 1:
        raise ValueError("a batch of texts was read again in another form")
    docs, sizes = np.frombuffer(heads[0]["docs"], "<i8"), np.frombuffer(heads[0]["sizes"], "<u4").astype(np.int64)

    def flags(n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for r in rows:
            out[np.frombuffer(r["places"], "<u4")] |= np.frombuffer(r["flags"], np.uint8)
        return out

    return docs, sizes, flags


# --- 2. cover sample


def _cover_rows(cover: Cover, buckets: int):
    def names(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = _BYTE[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.array([len(x) for x in raw], np.int64)
        text, place = cover.points(sizes)
        begin = (np.cumsum(sizes) - sizes)[text] + place
        short = range_hashes(buf, begin, begin + cover.short)
        long = range_hashes(buf, begin, begin + np.minimum(cover.long, sizes[text] - place), _SECOND)
        high = np.uint64(0xFFFFFFFF00000000)
        return (short & high) | (long >> np.uint64(32)), (short & np.uint64(buckets - 1)).astype(np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        sizes: list[int] = []
        ranks: list[np.ndarray] = []
        where: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            out = _sent(docs[0], np.array(docs), np.array(sizes), np.concatenate(ranks), np.concatenate(where), buckets)
            for x in (docs, sizes, ranks, where):
                x.clear()
            return out

        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in groups(raw, 1 << 19):
                rank, bucket = names(raw[lo:hi])
                docs += ids[lo:hi]
                sizes += map(len, raw[lo:hi])
                ranks.append(rank)
                where.append(bucket)
                if sum(sizes) >= BATCH:
                    yield flush()
        if docs:
            yield flush()

    return rows


def _marked(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a range, ends included."""
    steps = np.bincount(begins, minlength=n + 1).astype(np.int32)
    steps -= np.bincount(ends + 1, minlength=n + 1).astype(np.int32)
    return np.cumsum(steps[:n], dtype=np.int32) > 0


def _ranges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _settled(cover: Cover):
    """doc, wanted and tied of each text of a batch: ranges [begin, end) of windows, flattened."""

    def rows(table: pa.Table) -> pa.Table:
        docs, sizes, flags = _of_batch(table)
        text, place = cover.points(sizes)
        flag = flags(len(text))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        n, last = int(edge[-1]), sizes[text] - cover.width
        seen = (flag & _SEEN > 0) & (last >= 0)
        low, high = np.maximum(place - cover.period + 1, 0), np.minimum(place, last)
        seen &= low <= high
        wanted = _marked((edge[text] + low)[seen], (edge[text] + high)[seen], n)
        reach = np.minimum(cover.long, sizes[text] - place) - cover.width
        later, tied = (np.flatnonzero((flag & f > 0) & (reach >= 0)) for f in (_LATER, _TIED))
        begin = edge[text] + place
        wanted &= ~_marked(begin[later], (begin + reach)[later], n)
        found = []
        for marked in (wanted, _marked(begin[tied], (begin + reach)[tied], n)):
            a, b = _ranges(marked)
            own = np.searchsorted(edge, a, "right") - 1
            flat = np.stack([a - edge[own], b - edge[own]], axis=1).reshape(-1)
            cuts = 2 * np.searchsorted(own, np.arange(len(docs) + 1))
            found.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())))
        give_back()
        some = np.flatnonzero((np.diff(found[0].offsets) > 0) | (np.diff(found[1].offsets) > 0))
        return pa.table({"doc": pa.array(docs), "wanted": found[0], "tied": found[1]}).take(pa.array(some))

    return rows


# --- 4. suffix buckets


def _window_rows(width: int, buckets: int, most: int = 1 << 19):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        ranges: list[np.ndarray] = []
        ranks: list[np.ndarray] = []
        where: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            # A batch goes by its first text, and no text is in two batches.
            out = _sent(int(docs[0][0]), np.concatenate(docs), np.concatenate(ranges).reshape(-1), np.concatenate(ranks), np.concatenate(where), buckets)
            for x in (docs, ranges, ranks, where):
                x.clear()
            return out

        for batch in batches:
            for doc, body, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                buf = _BYTE[np.frombuffer(body, np.uint8)]
                pairs = np.array(flat, np.int64).reshape(-1, 2)
                sizes = pairs[:, 1] - pairs[:, 0]
                begin = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(pairs[:, 0], sizes)
                docs.append(np.full(len(pairs), doc, np.int64))
                ranges.append(pairs)
                ranks.append(range_hashes(buf, begin, begin + width, _SECOND))
                where.append((range_hashes(buf, begin, begin + width) & np.uint64(buckets - 1)).astype(np.int32))
                if sum(map(len, ranks)) >= most:
                    yield flush()
        if docs:
            yield flush()

    return rows


def _repeated(table: pa.Table) -> pa.Table:
    """doc and tied (ranges of repeated windows, flattened) of a batch of windows."""
    docs, sizes, flags = _of_batch(table)
    pairs = sizes.reshape(-1, 2)
    lengths = pairs[:, 1] - pairs[:, 0]
    hit = np.flatnonzero(flags(int(lengths.sum())) & _TIED)
    edge = np.concatenate([[0], np.cumsum(lengths)])
    own = np.searchsorted(edge, hit, "right") - 1
    doc, at = docs[own], pairs[own, 0] + hit - edge[own]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)])) if len(at) else np.empty(0, np.int64)
    end = np.concatenate([begin[1:], [len(at)]])[: len(begin)]
    first = np.flatnonzero(np.concatenate([[True], np.diff(doc[begin]) != 0])) if len(begin) else begin  # texts come in any order, each together
    flat = np.stack([at[begin], at[end - 1] + 1], axis=1).reshape(-1) if len(begin) else np.empty(0, np.int64)
    cuts = 2 * np.append(first, len(begin))
    return pa.table({"doc": pa.array(doc[begin][first], pa.int64()), "tied": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))})


# --- the operator


def _buckets(names: float) -> int:
    return 1 << min(max((int(names / BUCKET_NAMES)).bit_length(), 8), MAX_BUCKETS.bit_length() - 1)


def repeated_ranges(docs: DataFrame, text: str, width: int, scratch: Scratch) -> DataFrame:
    """(key, whole, spans) of every text that loses bytes, by the digest of its bytes: ``whole`` where two rows have it,
    else byte ranges [begin, end), flattened, in any order."""
    cover = cover_of(width)
    source = docs.select(F.encode(F.col(text), "utf-8").alias("body")).withColumn("key", F.unhex(F.md5("body"))).where(F.octet_length("body") >= width)
    many = scratch.write(source.groupBy("key").count().where("count > 1").select("key"), "many")
    once = key_join(source, many, "key", "left_anti").unionByName(key_join(source, many, "key", "left_semi").dropDuplicates(["key"]).select("body", "key"))
    begins = F.sequence(F.lit(0), F.octet_length("body") - width, F.lit(PIECE))
    pieces = once.select("key", "body", F.explode(begins).alias("start"))
    pieces = pieces.select("key", "start", F.expr(f"substring(body, start + 1, {PIECE + width - 1})").alias("body"))
    texts = scratch.write(pieces.select(F.monotonically_increasing_id().alias("doc"), "key", "start", "body"), "texts")

    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = _buckets(size * len(cover.residues) / cover.period)
    told = texts.select("doc", "body").mapInArrow(released(_cover_rows(cover, buckets)), _SENT).groupBy("bucket").applyInArrow(_sorted_bucket, _TOLD)
    settled = scratch.write(told.groupBy("batch").applyInArrow(_settled(cover), "doc long, wanted array<int>, tied array<int>"), "settled")

    wanted = scratch.write(settled.where(F.size("wanted") > 0).select("doc", "wanted"), "wanted")
    lengths = F.aggregate("wanted", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less begins, as they alternate
    buckets = _buckets(wanted.agg(F.sum(lengths)).first()[0] or 0)
    left = key_join(texts.select("doc", "body"), wanted, "doc", "inner").select("doc", "body", "wanted")
    told = left.mapInArrow(released(_window_rows(width, buckets)), _SENT).groupBy("bucket").applyInArrow(_sorted_bucket, _TOLD)
    sorted_ = scratch.write(told.groupBy("batch").applyInArrow(_repeated, "doc long, tied array<int>"), "sorted")

    tied = settled.select("doc", "tied").unionByName(sorted_).where(F.size("tied") > 0).join(texts.select("doc", "key", "start"), "doc")
    spans = F.transform("tied", lambda x, i: x.cast("long") + F.col("start") + F.when(i % 2 == 1, width - 1).otherwise(0))
    rows = tied.select("key", F.lit(False).alias("whole"), spans.alias("spans")).unionByName(many.select("key", F.lit(True).alias("whole"), F.lit(None).cast("array<long>").alias("spans")))
    found = rows.groupBy("key").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("spans")).alias("spans"))
    found = scratch.write(found.select("key", "whole", F.when(~F.col("whole"), F.col("spans")).alias("spans")), "found")
    scratch.drop("texts", "settled", "wanted", "sorted")
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(bodies: pa.Array, wholes: pa.Array, spans: pa.Array) -> pa.Array:
    kept, gone = [], []
    for body, whole, flat in zip(bodies, wholes.to_pylist(), spans.to_pylist(), strict=True):
        raw, merged = body.as_py(), []
        if raw is not None and whole:
            merged = [[0, len(raw)]]
        for a, b in sorted(zip((flat or ())[::2], (flat or ())[1::2], strict=True)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if raw is not None and merged:
            edges = [0, *(x for s in merged for x in s), len(raw)]
            raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        kept.append(raw)
        gone.append([{"start": a, "end": b} for a, b in merged])
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(gone, _SPANS)], ["kept", "spans"])


def dedup_bytes(docs: DataFrame, text: str = "text", width: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """All rows of ``docs`` with n_bytes, kept (the bytes left; null for a null text) and removed_spans, the removed
    ranges array<struct<start, end>> in bytes, in order, none of them touching the next."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = repeated_ranges(docs, text, width, scratch)
    body = F.encode(F.col(text), "utf-8")
    rows = docs.select(F.struct("*").alias("row"), body.alias("body")).withColumn("key", F.unhex(F.md5("body")))
    cutter = F.arrow_udf(_cut, "struct<kept:binary,spans:array<struct<start:long,end:long>>>").asNondeterministic()  # cut once, not for each field
    out = key_join(rows, found, "key", "left").withColumn("cut", cutter("body", "whole", "spans"))
    out = out.select("row", F.octet_length("body").cast("long").alias("n_bytes"), F.col("cut.kept").alias("kept"), F.col("cut.spans").alias("removed_spans"))
    return unpacked(out, docs.columns, "n_bytes", "kept", "removed_spans")
