"""Steps that searches share, at sizes of blocks that cut the tables many times."""

import random

from pyspark.sql import functions as F

from paperloom.operators import blocks, dense, impact, lexical
from paperloom.sources.scratch import written


def _texts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words[: 3 + i % 38]) for _ in range(1 + i % 23))) for i in range(150)] + [(200, None), (201, ""), (202, "w1 w2 w3"), (203, "w1 w2 w3")]
    asked = [(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(30)] + [(40, "w1 w1 w2"), (41, "nothing here"), (42, None)]
    return spark.createDataFrame(texts, "chunk_id long, content string"), spark.createDataFrame(asked, "question_id long, question string")


def test_scores_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """Ties over block borders, repeated terms, questions without a hit; before, a row was shuffled for every shared term."""
    docs, asked = _texts(spark)
    plain = lexical.bm25(asked, lexical.build_index(docs)).withColumn("score", F.round("score", 8))
    index = lexical.query_index(asked, docs)
    rows = lambda df: sorted(map(tuple, df.select("question_id", "chunk_id", "score", "rank").collect()))
    for weights, entries in ((1 << 17, 1 << 20), (9, 40)):
        monkeypatch.setattr(blocks, "WEIGHT_BLOCK", weights)
        monkeypatch.setattr(blocks, "ENTRY_BLOCK", entries)
        for k in (3, 500):
            got = lexical.bm25_topk(asked, index, k)
            assert rows(got) == rows(lexical.topk(plain, k))
    told = lexical.corpus_stats(docs).first()
    assert tuple(index.stats.first()) == (told["n"], told["avgdl"])
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "FlatMapCoGroups" in plan


def test_long_terms_are_looked_up_by_words(spark):
    """Texts are cut into words; before, into all their grams of three characters, some hundred rows for each text."""
    texts = [(1, "xa bc def gh ij"), (2, "a bc  def g"), (3, "a\nbc def gh"), (4, None), (5, "bc def"), (6, "a bc def ghi"), (7, "q"), (8, "a  b"), (9, "za bc def g")]
    terms = ["a bc def g", "bc def", "a  b", "q", " bc ", "", "def gh ij", "no such term"]
    out = lexical.contained_terms(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "k", "text")
    assert sorted(map(tuple, out.collect())) == sorted((k, t) for k, x in texts for t in terms if x and t and t in x)
    words = spark.createDataFrame([("one two three four",), ("  ",), ("two words",)], "t string").select(lexical._inner_words(F.col("t")).alias("w"))
    assert [r["w"] for r in words.collect()] == [["two", "three"], [], []]


def test_sample_of_lists_is_dealt(spark, monkeypatch):
    """Before, the sample was one task's, and each vector was placed twice."""
    asked = []
    monkeypatch.setattr(dense, "written", lambda df, keep=dense.written: asked.append(df) or keep(df))
    vectors = spark.range(300).select(F.col("id").alias("point_id"), F.array(*[F.cos(F.col("id") * 3.0 + i * i) for i in range(8)]).alias("embedding"))
    queries = vectors.where("point_id % 10 = 0").select(F.col("point_id").alias("query_id"), F.col("embedding").alias("query"))
    model = dense.fit_lists(vectors, 4)
    assert asked[0].rdd.getNumPartitions() == dense.FIT_PARTS
    got = dense.ivf_topk(queries, vectors, model, 1, 4).select("query_id", "point_id").collect()
    assert len(asked) == 3 and all(r["query_id"] == r["point_id"] for r in got) and len(got) == 30


def test_texts_are_cut_once_and_counted_without_a_shuffle(spark, monkeypatch):
    """Before, a filter on the number of tokens cut each text a second time, and every token was a row to be counted."""
    docs, asked = _texts(spark)
    monkeypatch.setattr(lexical, "COUNTED_ROWS", 7)
    posts = lexical.postings(docs)
    held = {i: [w for w in (x or "").split() if len(w) > 1] for i, x in ((r["chunk_id"], r["content"]) for r in docs.collect())}
    assert sorted(map(tuple, posts.select("chunk_id", "term", "tf", "doc_len").collect())) == sorted((i, w, ws.count(w), len(ws)) for i, ws in held.items() for w in set(ws))
    for df in (posts, lexical.corpus_stats(docs)):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("split(") == 1
    assert "Exchange" not in posts._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_impact_search_scores_in_blocks(spark):
    """Before, every pair of a question and a candidate was joined with all terms of the chunk, and the seeds' read shuffled all postings."""
    docs, asked = _texts(spark)
    index = impact.build_impact_index(docs)
    plain = lexical.bm25(asked, lexical.build_index(docs)).withColumn("score", F.round("score", 8))
    rows = lambda df: sorted(map(tuple, df.select("question_id", "chunk_id", "score", "rank").collect()))
    got = impact.impact_topk(asked, index, 3)
    assert rows(got) == rows(lexical.topk(plain, 3))
    assert "FlatMapCoGroups" in got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    first = written(impact.seeds(impact.question_weights(asked, index), 3, "question_id"))
    plan = impact.seed_keys(index, first, "question_id")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 2 and plan.index("paperloom_postings") < plan.rindex("Exchange")  # the seeds, and the keys found
