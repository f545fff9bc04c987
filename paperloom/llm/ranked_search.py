r"""Ranked lexical search (operator 12): the best documents of every question from K2-treaps over terms and documents.

Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII in the whole text, A-Z lower-cased.
The impact of a term in a document is whole-number BM25, ``(1000000000 * tf) div (1000 * tf + 8 * m)`` with
``m = 10 + (90 * n * N) div L``; a document's score sums weight times impact over the question's distinct terms, with
weight ``floor(1000 * ln((2N + 2) / (2 * df + 1)))``. N, L and df are counted over all documents.

Index. Documents are not shuffled: each task gathers blocks of them (``BLOCK_BYTES`` of text; a longer text is a block of its own). A
block is a grid with a row for each term, most frequent first, and a column for each document, in order of ids; its
points are impacts. The grid is a quadtree, kept as one mask of four bits for each inner cell in level order, so that
a cell's children are found by counting bits; beside it lies the largest impact below every cell, as its difference from
the cell above in directly addressable codes. An index is a Parquet table with a row for each block and can be searched
again and again; its impacts hold for the counts of the documents that it was built from.

Search. A batch of questions with its weights (``ITEM_BYTES`` of text at most) is broadcast; a larger set is searched
in several batches. In a block the paths of a question's rows descend together: a state is a range of documents
with the cell of every term on it, and the sum of weights times cell maxima bounds all scores in the range. The best
states are opened first, many at a time, until none can reach the k-th score, which is carried from block to block.
States of equal bound stay, so ties are exact. Every task hands on k rows for each question; a window ranks them.

Null and empty texts have no terms: such documents are not counted and such questions get no rows. Equal scores go by
ascending id, null ids last. Repeated rows of documents count each; repeated rows of questions count once. Empty
tables give no rows. Extra columns are ignored. A very long text is bounded by its own row.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, released, slices
from paperloom.llm.token_files import Segment, pack

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_IN_TERM = np.zeros(256, np.int8)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
ITEM_BYTES = 4 << 20
#: States that are opened at once.
WIDE = 192
_ONES = np.array([bin(i).count("1") for i in range(16)], np.uint8)


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


# --- the treap of one block


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(height, largest impact, cells, differences) of the points (row, column, impact), each place once."""
    height = max(int(max(rows.max(), columns.max())).bit_length(), 1)
    code = _spread(rows) << np.uint64(1) | _spread(columns)
    order = np.argsort(code)
    code, most = code[order], impacts[order].astype(np.uint32)
    cells, apart = [], []
    for _ in range(height):
        above = code >> np.uint64(2)
        begin = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        cells.append(np.bitwise_or.reduceat((1 << (code & np.uint64(3)).astype(np.int64)).astype(np.uint8), begin))
        high = np.maximum.reduceat(most, begin)
        apart.append(np.repeat(high, np.diff(np.append(begin, len(code)))) - most)
        code, most = above[begin], high
    masks = np.concatenate(cells[::-1])
    if len(masks) % 2:
        masks = np.append(masks, np.uint8(0))
    return height, int(most[0]), (masks[::2] | masks[1::2] << 4).tobytes(), pack(np.concatenate(apart[::-1]))


class Treap:
    """A block's treap, opened for search. Cells go by their number in level order; the last entry of each array, which
    -1 finds, stands for no cell."""

    def __init__(self, height: int, top: int, cells: bytes, apart: bytes):
        packed = np.frombuffer(cells, np.uint8)
        masks = np.stack([packed & 15, packed >> 4], axis=1).reshape(-1)
        codes = Segment(apart)
        apart = codes.slice(0, codes.n)
        values, begin, done = [np.array([top], np.uint32)], 0, 0
        for _ in range(height):
            own = values[-1]
            n = _ONES[masks[begin : begin + len(own)]]
            below = np.repeat(own, n)
            values.append(below - apart[done : done + len(below)])
            begin, done = begin + len(own), done + len(below)
        self.height, self.masks = height, np.append(masks[:begin], np.uint8(0))
        self.first = np.cumsum(_ONES[self.masks], dtype=np.int32) - _ONES[self.masks] + 1
        self.values = np.append(np.concatenate(values), np.uint32(0)).astype(np.int64)

    def best(self, rows: np.ndarray, weights: np.ndarray, least: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, scores) of ranges opened best first, with every column of the k best scores, if ``least`` or more.
        ``least`` is at least 1."""
        cells = np.zeros((1, len(rows)), np.int32)
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(self.values[0]) * int(weights.sum())])
        top = np.empty(0, np.int64)
        while True:
            open_ = bound >= least
            if not open_.any():
                return
            if not open_.all():
                cells, level, column, bound = cells[open_], level[open_], column[open_], bound[open_]
            if len(bound) > WIDE:
                order = np.argpartition(-bound, WIDE)
                now, rest = order[:WIDE], order[WIDE:]
            else:
                now, rest = np.arange(len(bound)), np.empty(0, np.int64)
            c, deep = cells[now], level[now]
            mask, first = self.masks[c].astype(np.int64), self.first[c]
            high = (rows[None, :] >> (self.height - 1 - deep)[:, None] & 1) * 2
            told = [(cells[rest], level[rest], column[rest], bound[rest])]
            for bit in (0, 1):
                q = high + bit
                child = np.where(mask >> q & 1, first + _ONES[mask & ((1 << q) - 1)], -1)
                told.append((child, deep + 1, column[now] * 2 + bit, self.values[child] @ weights))
            cells, level, column, bound = (np.concatenate(x) for x in zip(*told))
            leaf = (level == self.height) & (bound >= least)
            if leaf.any():
                yield column[leaf], bound[leaf]
                top = np.sort(np.concatenate([top, bound[leaf]]))[-k:]
                if len(top) == k:
                    least = max(least, int(top[0]))
            open_ = level < self.height
            cells, level, column, bound = cells[open_], level[open_], column[open_], bound[open_]


# --- index


@dataclass(frozen=True)
class Index:
    """A stored index: its blocks, the number of documents with a term (N) and of all their terms (L)."""

    blocks: DataFrame
    documents: int
    terms: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        raw = [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()]
        inside = _IN_TERM[np.frombuffer(b" ".join([b"", *raw]), np.uint8)]
        begun = np.flatnonzero(inside[1:] > inside[:-1]) if len(inside) else np.empty(0)
        n = np.bincount(np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), begun, "right"), minlength=len(raw))
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])


_BLOCK = "docs array<{0}>, terms binary, dfs binary, height int, top long, cells binary, apart binary"


def _blocks(documents: int, total: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        ids: list = []
        counts: list[int] = []
        found: list[np.ndarray] = []
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        size = 0

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            n = np.array(counts, np.int64)
            m = 10 + 90 * n * documents // total
            point, tf = np.unique(np.repeat(place, n) << 32 | np.concatenate(found), return_counts=True)
            column, term = point >> 32, point & 0xFFFFFFFF
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[order][column])
            df = np.bincount(term, minlength=len(known))
            names = list(known)
            ranked = sorted(range(len(names)), key=lambda t: (-df[t], names[t]))
            row = np.empty(len(ranked), np.int64)
            row[ranked] = np.arange(len(ranked))
            treap = build_treap(row[term], column, impact)
            told = [[[ids[i] for i in order]], [b"\n".join(names[t] for t in ranked)], [df[ranked].astype("<u4").tobytes()], *([x] for x in treap)]
            kinds = [pa.list_(kind), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            for x in (ids, counts, found, known):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(told, kinds, strict=True)], ["docs", "terms", "dfs", "height", "top", "cells", "apart"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    words = TERM.findall((text or b"").lower())
                    if not words:
                        continue
                    if ids and (size + len(text) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                        yield flush()
                        size = 0
                    ids.append(i)
                    counts.append(len(words))
                    found.append(np.array([known[w] for w in words], np.int64))
                    size += len(text)
        if ids:
            yield flush()

    return rows


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> Index:
    """The index of all rows of ``docs``, written to the shared folder."""
    scratch = scratch or Scratch(docs.sparkSession)
    told = docs.select(text).mapInArrow(released(_counted), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    documents, total = told[0] or 0, told[1] or 0
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(released(_blocks(documents, total)), _BLOCK.format(kind))
    return Index(scratch.write(rows, "treaps"), documents, total)


# --- search


def _term_counts(sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = sent.value, defaultdict(int)
        for batch in batches:
            for names, dfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, n in zip(names.split(b"\n"), np.frombuffer(dfs, "<u4").tolist(), strict=True):
                    if name in wanted:
                        total[name] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "df"])

    return rows


def _found(sent, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best: dict[int, list] = defaultdict(list)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            columns = ("docs", "terms", "height", "top", "cells", "apart")
            for i in range(batch.num_rows):
                docs, names, height, top, cells, apart = (batch.column(c)[i].as_py() for c in columns)
                row = {name: r for r, name in enumerate(names.split(b"\n")) if name in weight}
                treap = Treap(height, top, cells, apart)
                for no, own in enumerate(items):
                    here = [t for t in own if t in row]
                    if not here:
                        continue
                    held = best[no]
                    least = -held[k - 1][0] if len(held) >= k else 1
                    met: list[tuple] = []
                    for column, score in treap.best(np.array([row[t] for t in here]), np.array([weight[t] for t in here]), least, k):
                        met += [(-s, docs[c] is None, docs[c] if docs[c] is not None else 0) for c, s in zip(column.tolist(), score.tolist(), strict=True)]
                    if met:
                        best[no] = sorted(held + met)[:k]
        told = [(no, None if null else doc, -score) for no, held in best.items() for score, null, doc in held]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told), (pa.int32(), kind, pa.int64()), strict=True)], ["no", "doc", "score"])

    return rows


def _batches(items: DataFrame) -> Iterator[list]:
    """Questions in batches of about ``ITEM_BYTES`` of text."""
    held, size = [], 0
    for r in items.toLocalIterator():
        own = dict.fromkeys(terms(r[1]))
        if own:
            held.append((r[0], list(own)))
            size += len(r[1])
        if size >= ITEM_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(items: DataFrame, index: Index, key: str = "item_id", text: str = "text", doc: str = "doc_id", k: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """``key``, rank (from 1), ``doc`` and score of the ``k`` best documents of every question, those above 0 only."""
    spark = items.sparkSession
    scratch = scratch or Scratch(spark)
    item_kind = items.schema[key].dataType.simpleString()
    doc_kind = index.blocks.schema["docs"].dataType.elementType.simpleString()
    out = spark.createDataFrame([], f"{key} {item_kind}, rank int, {doc} {doc_kind}, score long")
    for turn, held in enumerate(_batches(items.select(key, text).distinct())):
        wanted = spark.sparkContext.broadcast(frozenset(t for _, own in held for t in own))
        counted = index.blocks.select("terms", "dfs").mapInArrow(released(_term_counts(wanted)), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = {bytes(t): math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1))) for t, df in counted.collect()}  # the batch's terms at most
        wanted.unpersist()
        sent = spark.sparkContext.broadcast(([own for _, own in held], weight))
        rows = index.blocks.mapInArrow(released(_found(sent, k)), f"no int, doc {doc_kind}, score long")
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame([(no, i) for no, (i, _) in enumerate(held)], f"no int, {key} {item_kind}")
        rows = rows.join(F.broadcast(names), "no").select(key, "rank", F.col("doc").alias(doc), "score")
        out = out.unionByName(scratch.write(rows, f"found_{turn}"))
        sent.unpersist()
    return out
