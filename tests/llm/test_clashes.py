"""Extra columns with the names that operators use inside, in every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import chat_format, decontaminate, line_dedup, ngram_join, quality_rules, sharding, span_dedup, url_filter
from tests.llm.test_dedup import lines, near, text

NAMES = "_cuts _rid rid id row _id cuts _text text2 first_id2 start end h1 hash body _key _quality _fits _row _h _grams _tf _rule host2 comp crowd g n m keys gone".split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(31)
    shared, base = "\n".join(lines(r, 4)), text(r, 90)
    texts = [text(r, 80) + "\n" + shared, shared + "\n" + text(r, 60), base, near(r, base, 1), base, None, "", "one", text(r, 200)]
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for x in NAMES:
        df = df.withColumn(x, F.concat(F.lit(x + " of "), "doc_id"))
    path = corpus_pipeline.Scratch(spark).write(df, "clashing")
    return path


def kept(out, *changed):
    for x in out.collect():
        for name in NAMES:
            if name not in changed:
                assert x[name] == f"{name} of {x['doc_id']}", name


def test_operators_keep_clashing_columns(spark, docs):
    out = quality_rules.quality_rules(docs)
    assert out.columns == [*docs.columns, "quality"] and out.count() == 9
    kept(out)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines", "first_ids", "emptied"] and out.where("removed_lines > 0").count() >= 1
    kept(out)
    out = span_dedup.dedup_spans(docs)
    assert out.columns == [*docs.columns, "removed_spans", "first_id"] and out.where("removed_spans IS NOT NULL").count() >= 2
    kept(out)
    urls = docs.withColumn("url", F.concat(F.lit("http://a.org/fr/"), "doc_id"))
    data = [(i, f"http://{'ab'[i % 2] * 5}.com/{i}", i % 2) for i in range(40)]
    model = url_filter.fit_url_model(spark.createDataFrame(data, "id long, url string, blocked int"))
    out = url_filter.filter_urls(urls, model, [url_filter.UrlRule("allow", "org", "/fr/")])
    assert out.columns == [*urls.columns, "host", "path", "rule", "block_probability", "verdict"] and {x["rule"] for x in out.collect()} == {"org/fr/"}
    kept(out)
    out = url_filter.filter_urls(urls.withColumnRenamed("url", "host"), model, [], url="host")
    assert {x["host"] for x in out.collect()} == {"a.org"}


def test_operators_ignore_clashing_columns(spark, docs):
    plain = docs.select("doc_id", "text")
    for f in (ngram_join.ngram_components, lambda d: sharding.shard_by_bytes(d, 3)):
        assert sorted(map(str, f(docs).drop("_rid").collect())) == sorted(map(str, f(plain).drop("_rid").collect()))
    items = docs.where("doc_id = 2").select(F.col("doc_id").alias("item_id"), "text", "rid", "seed") if "seed" in docs.columns else docs.where("doc_id = 2").withColumn("item_id", F.col("doc_id"))
    assert {x["doc_id"] for x in decontaminate.contaminated(docs, items).collect()} == {2, 3, 4}
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), chat_format.text_part(F.col("text")).alias("parts"), "_id", "rid", "row", "n")
    assert chat_format.format_chats(turns).count() == 9


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    docs.where("doc_id = 2").select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept(out)
        counts[name] = out.count()
    assert counts["n-gram Jaccard join"] == 7 and counts["benchmark decontamination"] == 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 9
