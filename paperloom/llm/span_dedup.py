r"""Substring dedup (operator 8): runs of consecutive sentences that occurred before are removed sentence by sentence.

Sentences end after ``.``, ``!``, ``?`` or ``…`` with white space behind, or at line ends; a sentence of more than
``long_words`` words is cut into pieces of half that length, so that one long sentence can make a run too. Words are
compared with A-Z lower-cased and white space collapsed. From every sentence on, the shortest run of at least
``min_sentences`` sentences and ``min_words`` words is hashed (128 bits), over every whole text.

All runs of the corpus are grouped by hash. The first occurrence is the one with the smallest document id (nulls last),
then row key, then place; every other one is a non-first repeated span, and each sentence that such a span covers is
removed, in the same document too.

Null and empty texts have no runs and come back as they are. Repeated rows, equal in id and text, count as one document
and are treated alike. Extra columns stay, whatever their names; only columns named removed_spans or first_id are
replaced. A very long text is bounded by its own row. Runs shared by very many documents are pre-aggregated before the
shuffle and their first places are broadcast to their rows; no list of a run's documents is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, hot_join, packed, patched, released, row_key, slices, unpacked
from paperloom.llm.hashing import groups, range_hashes, word_spans

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_STOP = np.zeros(256, np.bool_)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass(frozen=True)
class SpanParams:
    min_sentences: int = 2
    min_words: int = 20
    long_words: int = 30


def runs(texts: list[bytes], p: SpanParams) -> tuple[np.ndarray, ...]:
    """(text, start, end, hash, hash) of the shortest run from each sentence on; start and end in bytes of its text."""
    buf, words, starts, ends, first = word_spans(texts, lower=True)
    if not len(words):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    lines = np.cumsum(buf == 10)
    tail = np.concatenate([np.zeros(2, np.uint8), buf])  # tail[i] is the byte two before i
    stop = _STOP[buf[ends - 1]] | ((buf[ends - 1] == 0xA6) & (tail[ends] == 0x80) & (tail[ends - 1] == 0xE2))
    stop[:-1] |= lines[starts[1:] - 1] > lines[ends[:-1] - 1]  # texts are parted by a line end as well
    stop[-1] = True
    head = np.concatenate([[True], stop[:-1]])
    sentence = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    length = np.diff(np.concatenate([begin, [len(words)]]))
    step = max(p.long_words // 2, 1)
    stop |= (length[sentence] > p.long_words) & ((np.arange(len(words)) - begin[sentence] + 1) % step == 0)
    end = np.flatnonzero(stop) + 1
    begin = np.concatenate([[0], end[:-1]])
    last = np.maximum(np.searchsorted(end, begin + p.min_words), np.arange(len(begin)) + p.min_sentences - 1)
    fits = last < len(end)
    begin, last = begin[fits], last[fits]
    fits = text[begin] == text[end[last] - 1]
    begin, stop_at = begin[fits], end[last[fits]]
    owner = text[begin]
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])[owner]
    hashes = [range_hashes(words, begin, stop_at), range_hashes(words, begin, stop_at, _BASE)]
    return owner, starts[begin] - offset, ends[stop_at - 1] - offset, hashes[0].view(np.int64), hashes[1].view(np.int64)


def _run_rows(p: SpanParams):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            raw = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            for lo, hi in groups(raw):
                owner, start, end, h1, h2 = runs(raw[lo:hi], p)
                at = pa.array(owner + lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h1), pa.array(h2)],
                    ["_id", "_rid", "start", "end", "h1", "h2"],
                )

    return rows


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", params: SpanParams | None = None, scratch: Scratch | None = None) -> DataFrame:
    """A row for each non-first repeated span: _id, _rid (row key), start, end (UTF-8 bytes), first_id."""
    p = params or SpanParams()
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select(F.col(key).alias("_id"), row_key(key, text).alias("_rid"), F.col(text).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    spans = scratch.write(source.mapInArrow(released(_run_rows(p)), f"_id {id_type}, _rid binary, start int, end int, h1 long, h2 long"), "spans")
    many = scratch.write(spans.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "span_hashes")
    found = scratch.write(hot_join(spans, many, ["h1", "h2"], "n"), "span_repeats")
    scratch.drop("spans")
    place = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_rid").alias("rid"), F.col("start").alias("start"))
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.min("n").alias("n"))
    firsts = scratch.write(firsts.select("h1", "h2", "n", F.col("at.id").alias("first_id"), F.col("at.rid").alias("at_rid"), F.col("at.start").alias("at_start")), "span_firsts")
    hits = hot_join(found.drop("n"), firsts, ["h1", "h2"], "n").where(~((F.col("_rid") == F.col("at_rid")) & (F.col("start") == F.col("at_start"))))
    return hits.select("_id", "_rid", "start", "end", "first_id")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The rest of each text and its merged spans."""
    rest, places = [], []
    for t, c in zip(texts.cast(pa.binary()), spans, strict=True):
        t, gone = t.as_py(), merge_spans([(x["start"], x["end"]) for x in c.as_py()])
        edges = [0, *(x for s in gone for x in s), len(t)]
        rest.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8"))
        places.append([{"start": a, "end": b} for a, b in gone])
    return pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(places, _SPANS)], ["text", "spans"])


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", params: SpanParams | None = None, scratch: Scratch | None = None) -> DataFrame:
    """All rows of ``docs`` with the covered sentences cut out of ``text``.

    Adds removed_spans, array<struct<start, end>> in UTF-8 bytes of the old text, merged and in order (null: none), and
    first_id, the smallest id of a document that keeps one of them.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spans = repeated_spans(docs, key, text, params, scratch).withColumnRenamed("_rid", "rid")
    cuts = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("cuts"), F.min("first_id").alias("first_id"))

    def change(rows: DataFrame) -> DataFrame:
        cutter = F.arrow_udf(_cut, "struct<text:string,spans:array<struct<start:int,end:int>>>").asNondeterministic()  # cut once, not for each field
        cut = rows.withColumn("cut", cutter(F.col("text"), F.col("cuts")))
        return cut.withColumns({"text": F.col("cut.text"), "removed_spans": F.col("cut.spans")}).drop("cut", "cuts")

    out = patched(packed(docs, key, text), cuts, "rid", change, scratch, "span_cuts")
    return unpacked(out, docs.columns, "removed_spans", "first_id", **{text: F.col("text")})
