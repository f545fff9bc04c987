"""Suffix dedup against all pairs of windows, and its edges."""

import random
from collections import Counter

import numpy as np

from paperloom.llm import suffix_dedup


def plain(texts, width):
    """Removed byte ranges and the rest of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + width] for x in raw for i in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        edges = [i for i in range(len(x) + 1) if (gone[i - 1] if i else False) != (gone[i] if i < len(x) else False)]
        out.append((list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(x, gone) if not g)))
    return out


def corpus(seed, n=70):
    """Excerpts of one another at all distances, near copies, copies, texts that repeat in themselves, letters of two bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéßо") for _ in range(r.randrange(1, 9)))
    fresh = lambda k: " ".join(word() for _ in range(k))
    texts = [fresh(r.randrange(1, 60))]
    for _ in range(n):
        kind, old = r.random(), r.choice(texts) or "x"
        if kind < 0.3:
            texts.append(fresh(r.randrange(0, 50)))
        elif kind < 0.6:
            a = r.randrange(len(old))
            texts.append(fresh(r.randrange(0, 20)) + old[a : a + r.randrange(10, 120)] + fresh(r.randrange(0, 20)))
        elif kind < 0.8:
            a = r.randrange(len(old))
            texts.append(old[:a] + r.choice("xyz") + old[a + r.randrange(0, 2) :])
        elif kind < 0.9:
            texts.append(old)
        else:
            texts.append(old[: r.randrange(5, 90)] * r.randrange(2, 5))
    return texts


def run(spark, texts, width):
    rows = [(i, t, "keep", i, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, start long, kept string").repartition(3)
    out = {x["doc_id"]: x for x in suffix_dedup.dedup_bytes(frame, width=width).collect()}
    assert len(out) == len(texts) and all(x["key"] == "keep" and x["start"] == i for i, x in out.items())
    return [([(s["start"], s["end"]) for s in out[i]["removed_spans"]], bytes(out[i]["kept"] or b"")) for i in range(len(texts))]


def test_spans_match_all_windows(spark, monkeypatch):
    for seed, width, batch in ((1, 20, 8 << 20), (2, 46, 600), (3, 11, 300)):
        monkeypatch.setattr(suffix_dedup, "BATCH", batch)
        texts = corpus(seed)
        expected = plain(texts, width)
        assert sum(len(x[0]) for x in expected) > 30
        assert run(spark, texts, width) == expected


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    texts = corpus(4, 40)
    texts += [texts[3] * 20 + texts[5] * 3 + texts[8] * 9, "a" * 900, "a" * 30]
    assert run(spark, texts, 25) == plain(texts, 25)


def test_nulls_short_texts_and_repeated_rows(spark):
    texts = [None, "", "short", "short", "x" * 199, "x" * 200, "long enough " * 17, "long enough " * 17, None]
    out = run(spark, texts, 200)
    assert out == plain(texts, 200)
    assert out[6] == ([(0, 204)], b"") and out[5] == ([], b"x" * 200)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_batches_of_texts_in_any_order():
    import pyarrow as pa

    docs, pairs = np.array([9, 9, 4, 6], "<i8"), np.array([0, 3, 7, 9, 1, 2, 5, 8], "<u4")
    hits = np.array([0, 1, 3, 5, 7], "<u4")  # of 3 + 2 + 1 + 3 windows
    head = {"batch": 9, "docs": docs.tobytes(), "sizes": pairs.tobytes(), "places": hits.tobytes(), "flags": bytes([suffix_dedup._TIED] * 5)}
    out = suffix_dedup._repeated(pa.Table.from_pylist([head])).to_pylist()
    assert out == [{"doc": 9, "tied": [0, 2, 7, 8]}, {"doc": 4, "tied": [1, 2]}, {"doc": 6, "tied": [6, 7]}]


def test_covers_hold_every_distance():
    for period, residues in suffix_dedup.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    assert suffix_dedup.cover_of(200).period == 133
