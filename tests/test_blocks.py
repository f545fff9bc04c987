"""Search of vectors in blocks."""

import math
import random

from pyspark.sql import functions as F

from paperloom.operators import blocks, dense


def cosine(q, v):
    """As ``dense.cosine`` says: 0 without a length or with a null, null for other sizes."""
    void = lambda x: x is None or any(e is None for e in x) or not any(x)
    if void(q) or void(v):
        return 0.0
    if len(q) != len(v):
        return None
    return round(sum(a * b for a, b in zip(q, v)) / (math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(b * b for b in v))), 8)


def best(queries, vectors, k, by_type):
    out = []
    for i, q in queries:
        pools = {}
        for p, _, kind, v in vectors:
            pools.setdefault(kind if by_type else None, []).append((cosine(q, v), p))
        for pool in pools.values():
            pool.sort(key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))
            out += [(i, p, s, r) for r, (s, p) in enumerate(pool[:k], 1)]
    return sorted(out, key=str)


def _tables(spark):
    rng = random.Random(3)
    vec = lambda: [rng.choice((-2.0, -1.0, 0.5, 1.0, 3.0)) for _ in range(4)]
    vectors = [(p, p % 3, "abc"[p % 3], [1.0, 2.0, 2.0, 0.5] if p % 4 == 0 else vec()) for p in range(120)]
    vectors += [(200, 0, "a", None), (201, 0, "b", [0.0] * 4), (202, 0, None, [1.0, 2.0]), (203, 0, "c", [1.0, None, 2.0, 2.0]), (204, 0, "c", [])]
    queries = [(i, [1.0, 2.0, 2.0, 0.5] if i % 5 == 0 else vec()) for i in range(20)] + [(30, None), (31, [0.0] * 4), (32, [1.0, 1.0])]
    return queries, vectors, spark.createDataFrame(queries, "query_id long, query array<float>"), spark.createDataFrame(vectors, "point_id long, paper_id long, content_type string, embedding array<float>")


def test_blocks_find_what_all_pairs_hold(spark, monkeypatch):
    """Copies, ties over block borders, nulls, vectors without a length and of other sizes."""
    queries, vectors, q, v = _tables(spark)
    for size in ((4096, 16384), (7, 10)):
        monkeypatch.setattr(blocks, "QUERY_BLOCK", size[0])
        monkeypatch.setattr(blocks, "VECTOR_BLOCK", size[1])
        for by_type in (False, True):
            for k in (6, 200):
                got = dense.cosine_topk(q, v, k, by_type).select("query_id", "point_id", "score", "rank").collect()
                assert sorted(map(tuple, got), key=str) == best(queries, vectors, k, by_type)


def test_no_search_sorts_or_joins_all_pairs(spark, monkeypatch):
    """What leaves the blocks is bounded by k; before, each task ranked its pairs after a nested loop or a join of candidates."""
    monkeypatch.setattr(blocks, "VECTOR_BLOCK", 100)
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.array(*[F.cos(F.col("id") * 7.0 + i) for i in range(32)]).alias("query"))
    vectors = spark.range(400).select(F.col("id").alias("point_id"), F.lit(1).alias("paper_id"), F.lit("a").alias("content_type"), F.array(*[F.cos(F.col("id") * 3.0 + i * i) for i in range(32)]).alias("embedding"))
    book = dense.fit_codebook(vectors, size=8)
    found = {
        "exact": dense.cosine_topk(queries, vectors, 3),
        "buckets": dense.lsh_topk(queries, vectors, 3),
        "lists": dense.ivf_topk(queries, vectors, dense.fit_lists(vectors, 4), 3, 2),
        "codes": dense.pq_topk(queries, vectors, dense.quantize(vectors, book), book, 3, 10),
    }
    for name, df in found.items():
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan, name  # a row with the number of blocks is all that is broadcast
    told = blocks.block_topk(queries, vectors, 3, blocks.cosines)
    assert told.count() <= 20 * 3 * 4
