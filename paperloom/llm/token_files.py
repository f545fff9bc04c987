"""Token files (operator 10): all ids of a corpus in key order, in directly addressable codes.

A segment holds the ids of consecutive documents. Every id is split into chunks of eight bits, low ones first. Level 0
holds the first chunk of every id; a bitmap beside it says whether the id goes on, and level k + 1 holds the next chunk
of those that do. A directory of ones before every ``BLOCK`` bits gives ranks, so ``Segment.get(i)`` finds one id by one
look at each level and never decodes a block. The form of a segment, little-endian::

    "DAC1", u32 levels, u32 ids, then for each level: u32 entries, chunks u8[entries],
    bitmap u8[(entries + 7) // 8], directory u32[entries // BLOCK + 1]   (no bitmap and directory for the last level)

Segments are rows of Parquet files in the shared folder, so that Spark's own commit protocol and any store it reaches
hold them, uncompressed: part, seg, n_tokens, doc_ids, counts, codes. A document larger than ``SEGMENT_TOKENS`` is one segment.

Order is by key (nulls first), then text checksum; equal rows are interchangeable and are spread by a salt, so one key
with a large part of the rows makes no hot partition. Part totals, one row for each partition, give every part its
start in the corpus. Null and empty texts have the end id only; a text with a special string of the vocabulary gets
what the library gives it; a very long one is bounded by its own row. An empty table gives no segments. Extra columns are
not stored.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, key_join, released, small_batches

BLOCK = 512
SEGMENT_TOKENS = 1 << 20
#: Words remembered with their ids in each worker: so many new ones, and as many that were new before them.
CACHE = 500_000
MAX_VOCABULARY = 64_000_000


# --- codes


def pack(ids: np.ndarray) -> bytes:
    """The segment of ``ids`` (unsigned 32-bit)."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while True:
        levels += 1
        out += [struct.pack("<I", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes()]
        more = rest > 0xFF
        if not more.any():
            break
        before = np.concatenate([[0], np.cumsum(more)])[: len(more) // BLOCK * BLOCK + 1 : BLOCK]
        out += [np.packbits(more, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    return b"DAC1" + struct.pack("<II", levels, len(ids)) + b"".join(out)


class Segment:
    """Reads a packed segment; ``get`` addresses one id, ``slice`` decodes a range."""

    def __init__(self, data: bytes):
        magic, levels, self.n = struct.unpack_from("<4sII", data)
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at, self.levels = 12, []
        for k in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if k < levels - 1:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", n // BLOCK + 1, at)
                at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        low = i // BLOCK * BLOCK
        part = np.unpackbits(bits[low // 8 : (i + 7) // 8], bitorder="little")
        return int(ranks[i // BLOCK]) + int(part[: i - low].sum())

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    @staticmethod
    def _ranks(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each bit of ``at``: the directory's figure and the ones of at most one block."""
        block = at // BLOCK
        byte = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        part = np.where(byte < (at >> 3)[:, None], bits[np.minimum(byte, len(bits) - 1)], 0)
        rest = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return ranks[block].astype(np.int64) + np.bitwise_count(part).sum(axis=1, dtype=np.int64) + np.bitwise_count(rest)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at many places, each found like ``get`` finds one."""
        out = np.zeros(len(at), np.uint32)
        for lo in range(0, len(at), 4096):
            i, shift = np.asarray(at[lo : lo + 4096], np.int64), 0
            where = np.arange(lo, lo + len(i))
            for chunks, bits, ranks in self.levels:
                out[where] |= chunks[i].astype(np.uint32) << np.uint32(shift)
                if bits is None or not len(i):
                    break
                more = bits[i >> 3] >> (i & 7).astype(np.uint8) & 1 == 1
                i, where, shift = self._ranks(bits, ranks, i[more]), where[more], shift + 8
        return out

    def slice(self, begin: int, end: int) -> np.ndarray:
        out, where, shift = np.zeros(end - begin, np.uint32), np.arange(end - begin), 0
        for chunks, bits, ranks in self.levels:
            out[where] |= chunks[begin:end].astype(np.uint32) << np.uint32(shift)
            if bits is None or begin == end:
                break
            low = begin // 8 * 8
            more = np.unpackbits(bits[low // 8 : (end + 7) // 8], bitorder="little")[begin - low : end - low].astype(bool)
            begin = self._rank(bits, ranks, begin)
            where, shift = where[more], shift + 8
            end = begin + len(where)
        return out


# --- words to ids


#: Words of these letters (ASCII and Latin-1, UTF-8) reach the vocabulary's merges as they are but for case.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

_PUNCTUATION = string.punctuation.encode()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts through the tokenizers library, word by word with a memory of words.

    The vocabulary's pre-tokenizer drops white space and never joins what white space parts, and its normalizer works
    inside words, so a text's ids are those of its words in order. A word that ends in ASCII punctuation after a
    plain letter or digit parts there, too. Texts without combining marks are looked up with A-Z lower-cased, as the
    normalizer does. Words of plain Latin letters, which the normalizer only lower-cases and the pre-tokenizer keeps
    whole, go to the library's model at once; all others through its whole chain.
    """

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        #: A text with one of these strings goes through the library whole, which gives it their ids.
        self.special = [t["content"] for t in json.loads(vocabulary).get("added_tokens", ())]
        self.lowered = [x.encode("utf-8").lower() for x in self.special]
        self.model = self.tokenizer.model
        self.marks = regex.compile(r"\p{M}")
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _one(self, word: bytes) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.model.tokenize(word.decode("ascii").lower())]
        elif _PLAIN.fullmatch(word):
            raw = word.decode("utf-8").lower().encode("utf-8")
            ids = [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: bytes) -> bytes:
        """The ids of a word that ``known`` lacks, which then has it."""
        found = self.before.get(word)
        if found is None:
            core = word.rstrip(_PUNCTUATION)
            if len(core) < len(word) and (core[-1:].isalnum() or _PLAIN.fullmatch(core)):
                found = b"".join([self.known.get(x) or self._ids(x) for x in (core, word[len(core) :])])
            else:
                found = self._one(word)
        self.known[word] = found
        return found

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit little-endian bytes."""
        out = []
        for t in texts:
            if any(x in t for x in self.special):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
                continue
            if len(self.known) > CACHE:
                self.before, self.known = self.known, {}
            raw = t.encode("utf-8")
            low = raw.lower()
            # What is a special string only in lower case stays in its own case.
            own = not raw.isascii() and self.marks.search(t) or any(x in low for x in self.lowered)
            words = (raw if own else low).split()
            get, learn = self.known.get, self._ids
            out.append(b"".join([get(w) or learn(w) for w in words]))
        return out


@lru_cache(2)
def _encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(vocabulary)


class WordVocabulary:
    """A tokenizers file, read once on the driver and sent to the workers."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            data = f.read()
        if len(data) > MAX_VOCABULARY:
            raise ValueError(f"{path}: {len(data)} characters; {MAX_VOCABULARY} at most")
        self.sent = spark.sparkContext.broadcast(data)

    def encoder(self) -> WordEncoder:
        return _encoder(self.sent.value)


# --- files

_SEGMENTS = "part int, seg int, n_tokens long, doc_ids array<{0}>, counts array<long>, codes binary"


def _segments(vocabulary: WordVocabulary, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = vocabulary.encoder(), TaskContext.get().partitionId()
        ids, texts, size, seg, kind = [], [], 0, 0, None
        keys: list = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in held]
            columns = [[part], [seg], [sum(counts)], [keys], [counts], [pack(np.frombuffer(b"".join(held), "<u4"))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seg", "n_tokens", "doc_ids", "counts", "codes"])

        for batch in batches:
            kind = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                some = [x or "" for x in texts[lo : lo + 256].to_pylist()]
                for key, coded in zip(ids[lo : lo + 256], encoder.batch(some), strict=True):
                    if held and tokens + len(coded) // 4 + 1 > SEGMENT_TOKENS:
                        yield flush()
                        keys, held, tokens, seg = [], [], 0, seg + 1
                    keys.append(key)
                    held.append(coded + end)
                    tokens += len(coded) // 4 + 1
        if held:
            yield flush()

    return rows


#: Bytes of text that one part should hold.
PART_BYTES = 64 << 20


def write_tokens(docs: DataFrame, vocabulary: WordVocabulary, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all ``docs``, each with ``end_id`` behind, in key order to segment files in ``path``."""
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")).alias("_crc"))
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES), 1)
    rows = rows.repartitionByRange(parts, "_key", "_crc", "_salt").sortWithinPartitions("_key", "_crc", "_salt")
    with small_batches(spark):
        # Without compression: a code is where its directory says.
        rows.select("_key", "_text").mapInArrow(released(_segments(vocabulary, end_id)), _SEGMENTS.format(key_type)).write.mode("overwrite").option("compression", "none").parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """part, _base: ids in all earlier parts. As many rows as there are parts."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))


def placed_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before each."""
    segments = spark.read.parquet(path)
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", "seg", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_before"))
    places = places.join(F.broadcast(_starts(segments)), "part").select("part", "seg", (F.col("_base") + F.col("_before")).alias("start"))
    # A row for each million ids: as long as these fit, no code is shuffled to meet its start.
    return key_join(segments, Scratch(spark).write(places, "places"), ["part", "seg"], "inner")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for ids, counts, codes, start in zip(*(batch.column(c) for c in ("doc_ids", "counts", "codes", "start")), strict=True):
            segment, counts = Segment(codes.as_py()), np.array(counts.as_py(), np.int64)
            edges = np.concatenate([[0], np.cumsum(counts)])
            crcs = [zlib.crc32(segment.slice(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(edges[:-1] + start.as_py(), pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids_crc32 of every stored document, read from the files."""
    segments = placed_segments(spark, path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    rows = segments.select("doc_ids", "counts", "codes", "start").mapInArrow(released(_documents), f"key {kind}, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("key", key)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, places, codes in zip(*(batch.column(c) for c in ("start", "places", "codes")), strict=True):
            at = places.values.to_numpy() - start.as_py()
            yield pa.RecordBatch.from_arrays([places.values, pa.array(Segment(codes.as_py()).take(at), pa.int64())], ["at", "token"])


def read_tokens(spark: SparkSession, path: str, positions: DataFrame, position: str = "position", scratch: Scratch | None = None) -> DataFrame:
    """Adds ``token`` to ``positions``: the id at each place of the corpus, by direct access; outside of it null.

    Positions meet the narrow table of segment places on the megatoken that they lie in and are gathered by segment, so
    each segment's codes are joined once, whatever number of its places is asked for, and addressed in one call.
    """
    scratch = scratch or Scratch(spark)
    unit = SEGMENT_TOKENS
    segments = placed_segments(spark, path)
    units = F.sequence(F.floor(F.col("start") / unit), F.floor((F.col("start") + F.col("n_tokens") - 1) / unit))
    places = segments.select("part", "seg", "start", "n_tokens", F.explode(units).alias("unit"))
    wanted = positions.select(F.col(position).cast("long").alias("at")).where("at IS NOT NULL").distinct().withColumn("unit", F.floor(F.col("at") / unit))
    found = wanted.join(places, "unit").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n_tokens")))
    # Places are distinct, so a list is no longer than its segment.
    found = scratch.write(found.groupBy("part", "seg").agg(F.sort_array(F.collect_list("at")).alias("places")), "asked")
    rows = segments.select("part", "seg", "start", "codes").join(found, ["part", "seg"]).select("start", "places", "codes")
    told = rows.mapInArrow(released(_taken), "at long, token long").select(F.col("at").alias("_at"), F.col("token").cast("int").alias("token"))
    return positions.join(told, positions[position] == told["_at"], "left").drop("_at")
