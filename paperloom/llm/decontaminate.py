r"""Benchmark decontamination (operator 3): greedy string tiling of test items over documents.

Tokens are runs of letters and digits, lower-cased; in scripts that put no spaces between words (``UNSPACED``) every
letter is a token. A document is contaminated by an item when tiles, which are
non-overlapping common runs of at least ``min_match`` tokens in any order, cover ``threshold`` or more of the item's
tokens. So an item is caught whole, with other punctuation and case, and with its passages moved about.

1. Every item's runs of ``min_match`` tokens are the seeds. Documents are scanned for seeds; where seeds follow each
   other, the tokens between form a stretch. A tile lies inside one stretch, so a document is from here on its
   stretches, and documents without a seed are gone.
2. Stretches' seeds join the items' seeds; a pair of document and item goes on if the item positions whose seed occurs
   could cover enough.
3. Each pair is tiled: running Karp-Rabin hashes over windows of the least length find the common runs, which are marked
   longest first, cut back to what is unmarked, and counted. Of equal ones the first in the item goes first. A long text
   of one repeated token costs item times text steps at most.

The items are a stated set: they are dealt into blocks of about ``block_chars`` characters by hash, and each block is
run against all documents, so what is sent to the workers has a fixed bound however large the benchmark is.

An item with fewer than ``min_match`` tokens is one tile: a document that holds all of it in a row is contaminated. So a
benchmark of single words catches every document with such a word; ``min_item`` leaves out items with fewer tokens.
Items without a token, null ones too, match nothing. Null and empty documents
have no tokens. Repeated items with one id and text count once; repeated documents, equal in id and text, get equal
rows. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperloom.llm.common import Scratch, released, row_key
from paperloom.llm.hashing import groups, powers, shingles, word_hashes


@dataclass(frozen=True)
class TilingParams:
    min_match: int = 5
    threshold: float = 0.6
    block_chars: int = 8_000_000
    min_item: int = 1

    def least(self, tokens: int) -> int:
        """The tokens of the shortest tile of an item with so many tokens."""
        return min(self.min_match, tokens)


UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


#: The first of these scripts' blocks begins here: most texts hold nothing beyond, which one range tells.
_FROM_THAI = r"[\x{0E00}-\x{10FFFF}]"


def plain(text: Column) -> Column:
    """The tokens of a text with single spaces between."""
    runs = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.when(runs.rlike(_FROM_THAI), F.regexp_replace(runs, f"([{UNSPACED}])", " $1 ")).otherwise(runs)


def token_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    for lo, hi in groups(raw):
        words, first = word_hashes(raw[lo:hi])
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield words[a:b].view(np.int64)


# --- tiling

_BASE = np.uint64(1_000_003_777)
#: Pairs of equal windows looked at together.
PAIRS = 1_000_000


def _windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` tokens, by a running Karp-Rabin hash modulo 2**64."""
    values = tokens.view(np.uint64)
    up, down = powers(len(values) + 1, _BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * down[: len(values) - size + 1] if len(values) >= size else np.empty(0, np.uint64)


def _common_runs(item: np.ndarray, text: np.ndarray, free: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(length, place in item, place in text) of every longest common run of ``size`` tokens or more.

    Windows with equal hashes are compared token by token; those that follow each other on a diagonal are one run.
    Windows of the item are taken in blocks, so that repeated tokens cost time for each pair but no memory.
    """
    of_item, of_text = _windows(item, size), _windows(text, size)
    usable = np.flatnonzero(np.convolve(free, np.ones(size, np.int64), "valid") == size) if len(of_text) else np.empty(0, np.int64)
    usable = usable[np.argsort(of_text[usable], kind="stable")]
    known = of_text[usable]
    low, high = np.searchsorted(known, of_item, "left"), np.searchsorted(known, of_item, "right")
    edges = np.concatenate([[0], np.cumsum(high - low)])
    runs = [np.empty((0, 3), np.int64)]
    begin = 0
    while begin < len(of_item):
        end = max(int(np.searchsorted(edges, edges[begin] + PAIRS, "right")) - 1, begin + 1)
        count = high[begin:end] - low[begin:end]
        i = np.repeat(np.arange(begin, end), count)
        j = usable[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[begin:end], count)]
        same = np.ones(len(i), np.bool_)
        for k in range(size):
            same &= item[i + k] == text[j + k]
        i, diagonal = i[same], (j - i)[same]
        order = np.lexsort((i, diagonal))
        i, diagonal = i[order], diagonal[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(diagonal) != 0) | (np.diff(i) != 1)])) if len(i) else np.empty(0, np.int64)
        runs.append(np.stack([diagonal[heads], i[heads], np.diff(np.concatenate([heads, [len(i)]]))], 1))
        begin = end
    every = np.concatenate(runs)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    held: list[int] | None = None
    for diagonal, i, n in every.tolist():
        if held and held[0] == diagonal and held[1] + held[2] == i:  # goes on from the block before
            held[2] += n
            continue
        if held:
            yield held[2] + size - 1, held[1], held[0] + held[1]
        held = [diagonal, i, n]
    if held:
        yield held[2] + size - 1, held[1], held[0] + held[1]


def tile(item: list[int], text: list[int | None], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length). A None in ``text`` is a gap that no tile crosses.

    The longest match between unmarked tokens is marked first; of equal ones the first in the item, then in the text. A
    run that a longer tile has cut comes back as its unmarked rests. Time is bounded by item times text.
    """
    of_item = np.array(item, np.int64)
    free_text = np.array([t is not None for t in text], np.bool_)
    of_text = np.array([0 if t is None else t for t in text], np.int64)
    free_item = np.ones(len(item), np.bool_)
    if len(item) < min_match or len(text) < min_match:
        return []
    heap = [(-n, i, j) for n, i, j in _common_runs(of_item, of_text, free_text, min_match)]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = free_item[i : i + n] & free_text[j : j + n]
        if free.all():
            tiles.append((i, j, n))
            free_item[i : i + n] = free_text[j : j + n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= min_match:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


# --- Spark


def _stretches(seeds, min_match: int):
    """(id, row key, seeds, stretches) of the documents that hold a seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seeds.value
        for batch in batches:
            ids, rids, found, stretches = [], [], [], []
            keys = batch.column(1).to_pylist()
            for i, tokens in enumerate(token_rows(batch.column(2))):
                held, parts = [], []
                for size, seeds_of in known.items():
                    runs = shingles(tokens.view(np.uint64), size)
                    if not len(runs):
                        continue
                    at = np.minimum(np.searchsorted(seeds_of, runs), len(seeds_of) - 1)
                    hits = np.flatnonzero(seeds_of[at] == runs)
                    if not len(hits):
                        continue
                    each, place = np.unique(runs[hits], return_index=True)
                    held.append(each.view(np.int64))
                    if size == min_match:
                        ends = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
                        parts += [tokens[p[0] : p[-1] + size].tolist() for p in ends]
                    else:  # a whole short item, too short for any other's tile: once is enough
                        parts += [tokens[a : a + size].tolist() for a in hits[place]]
                if held:
                    ids.append(i)
                    rids.append(keys[i])
                    found.append(np.concatenate(held))
                    stretches.append(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(rids, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(stretches, pa.list_(pa.list_(pa.int64())))],
                ["_id", "_rid", "seeds", "stretches"],
            )

    return rows


def _tiled(items, p: TilingParams):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            keep, covered, tiles = [], [], []
            for i, (no, parts) in enumerate(zip(batch.column("no").to_pylist(), batch.column("stretches").to_pylist(), strict=True)):
                text: list[int | None] = []
                for part in parts:
                    text += [*part, None]
                found = tile(known[no], text, p.least(len(known[no])))
                total = sum(n for _, _, n in found)
                if total >= p.threshold * len(known[no]):
                    keep.append(i)
                    covered.append(total)
                    tiles.append(len(found))
            some = batch.take(pa.array(keep, pa.int32()))
            sizes = [len(known[no]) for no in some.column("no").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [some.column("_id"), some.column("_rid"), some.column("no"), pa.array(covered, pa.int32()), pa.array(sizes, pa.int32()), pa.array(tiles, pa.int32())],
                ["_id", "_rid", "no", "covered", "item_tokens", "tiles"],
            )

    return rows


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", params: TilingParams | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """A row for each contaminated pair: ``key``, ``item``, coverage, covered, item_tokens, tiles, and the row key ``_rid``."""
    p = params or TilingParams()
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    source = docs.select(F.col(key).alias("_id"), row_key(key, text).alias("_rid"), plain(F.col(text)).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    stated = items.select(F.col(item).alias("item"), plain(F.col(item_text)).alias("plain")).distinct()
    chars = stated.agg(F.sum(F.length("plain"))).first()[0] or 0
    blocks = max(1, -(-chars // p.block_chars))
    stated = stated.withColumn("block", F.pmod(F.xxhash64("item", "plain"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = stated.where(F.col("block") == block).select("item", "plain").collect()  # about block_chars characters
        tokens = [t.tolist() for t in token_rows(pa.array([r["plain"] for r in rows], pa.string()))]
        none = np.empty(0, np.uint64)
        usable = [len(t) >= max(p.min_item, 1) for t in tokens]
        seeds = [np.unique(shingles(np.array(t, np.int64).view(np.uint64), p.least(len(t)))) if use else none for t, use in zip(tokens, usable, strict=True)]
        lengths = {p.least(len(t)) for t, use in zip(tokens, usable, strict=True) if use}
        every = {n: np.unique(np.concatenate([s for s, t in zip(seeds, tokens, strict=True) if len(s) and p.least(len(t)) == n])) for n in sorted(lengths)}
        sent = spark.sparkContext.broadcast(every)
        held = source.mapInArrow(released(_stretches(sent, p.min_match)), f"_id {id_type}, _rid binary, seeds array<long>, stretches array<array<long>>")
        held = scratch.write(held, f"stretches_{block}")
        places = [(int(h), no) for no, s in enumerate(seeds) for h in s.view(np.int64)]
        seed_rows = spark.createDataFrame(pa.table({"seed": pa.array([x[0] for x in places], pa.int64()), "no": pa.array([x[1] for x in places], pa.int32())}))
        item_type = stated.schema["item"].dataType
        sizes = {"no": range(len(rows)), "item": [r["item"] for r in rows], "size": [len(t) for t in tokens]}
        kinds = [pa.int32(), to_arrow_type(item_type), pa.int32()]
        size_rows = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(sizes.values(), kinds, strict=True)], list(sizes)))
        hits = held.select("_rid", F.explode("seeds").alias("seed")).join(F.broadcast(seed_rows), "seed").groupBy("_rid", "no").agg(F.countDistinct("seed").alias("hits"))
        # A seed that occurs once in the item covers at most the tokens of a seed; an item of few distinct seeds repeats them.
        distinct = seed_rows.groupBy("no").agg(F.count("*").alias("own"))
        hits = hits.join(F.broadcast(distinct), "no").join(F.broadcast(size_rows), "no")
        least = F.least(F.lit(p.min_match), F.col("size"))
        spare = F.col("size") - (least - 1) - F.col("own")
        hits = hits.where((F.col("hits") + spare) * least >= p.threshold * F.col("size")).select("_rid", "no")
        pairs = held.dropDuplicates(["_rid"]).select("_id", "_rid", "stretches").join(hits, "_rid").repartition("_rid", "no")
        pairs = pairs.select("_id", "_rid", "no", "stretches").mapInArrow(released(
            _tiled(spark.sparkContext.broadcast(tokens), p)), f"_id {id_type}, _rid binary, no int, covered int, item_tokens int, tiles int"
        )
        named = pairs.join(F.broadcast(size_rows.select("no", "item")), "no")
        named = named.select(F.col("_id").alias(key), F.col("item").alias(item), (F.col("covered") / F.col("item_tokens")).alias("coverage"), "covered", "item_tokens", "tiles", "_rid")
        found = named if found is None else found.unionByName(named)
    return found
