"""Ranked search against scoring every document, and its edges."""

import math
import random
import re
from collections import Counter

import numpy as np

from paperloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, k=10):
    """Every item's best documents by scoring all of them."""
    told = [(i, Counter(split(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in told:
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(spark, items, docs, parts=4):
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(parts)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    out = ranked_search.search(asked, ranked_search.build_index(frame))
    return sorted(map(tuple, out.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [r.choice(["Ka", "lo", "MI", "né", "пу", "ra7", "x"]) + r.choice(["bar", "dan", "fel", "gor"]) + str(r.randrange(9)) for _ in range(150)]
    texts = [" ".join(words[min(int(r.expovariate(0.04)), 149)] for _ in range(r.randrange(0, 80))) + r.choice(["", "!", "_x-y"]) for _ in range(n)]
    texts += texts[:20] * 2  # ties
    return [(i, t) for i, t in enumerate(texts)], [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(25)]


def test_best_documents_match_all_scores(spark, monkeypatch):
    docs, items = corpus(1)
    docs += [(9000, None), (9001, ""), (9002, "... !"), (None, docs[3][1])]
    items += [(90, None), (91, "?"), (92, "nowhere"), (3, items[3][1]), (None, items[4][1])]
    expected = plain(items, docs)
    assert run(spark, items, docs) == expected
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 900)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 300)
    monkeypatch.setattr(ranked_search, "WIDE", 3)
    assert run(spark, items, docs, 2) == expected


def test_edges(spark):
    assert run(spark, [(1, "a")], [], 1) == []
    assert run(spark, [], [(1, "a")], 1) == []
    assert run(spark, [(1, "A b")], [(5, "a"), (5, "a"), (4, "c c")], 1) == plain([(1, "a b")], [(5, "a"), (5, "a"), (4, "c c")])


def test_treap_opens_a_part_of_its_cells():
    """A search for ten documents of one block opens few of the ranges that hold its terms."""
    r = np.random.default_rng(3)
    points = {(int(a), int(b)) for a, b in zip(r.zipf(1.3, 60000) % 4000, r.integers(0, 2000, 60000))}
    rows, columns = np.array(sorted(points)).T
    impacts = r.integers(1, 1_000_000, len(rows))
    treap = ranked_search.Treap(*ranked_search.build_treap(rows, columns, impacts))
    assert treap.values.max() == impacts.max()
    wanted, weights = np.array([40, 300, 7, 1200]), np.array([900, 3000, 400, 5000])
    found = [x for part in treap.best(wanted, weights, 1, 10) for x in zip(part[1].tolist(), (-part[0]).tolist())]
    score = np.zeros(2048, np.int64)
    for row, w in zip(wanted, weights):
        np.add.at(score, columns[rows == row], w * impacts[rows == row])
    best = sorted(((int(s), -c) for c, s in enumerate(score) if s), reverse=True)
    assert sorted(found, reverse=True)[:10] == best[:10]
