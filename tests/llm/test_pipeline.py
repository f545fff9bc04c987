import random

import corpus_pipeline
from paperloom.llm import line_dedup, quality_rules
from tests.llm import brute
from tests.llm.test_dedup import plain_line_dedup
from tests.llm.test_quality_url import prose
from tests.llm.test_tokens_tiles import encoding


def test_pipeline_matches_plain_version(spark, tmp_path):
    r = random.Random(1)
    items = [(i, prose(25, 900 + i)) for i in range(3)]
    texts = ["\n".join(prose(r.randrange(20, 60), 40 * k + j) for j in range(r.randrange(1, 6))) for k in range(25)]
    texts += [texts[0], texts[3], "short", None, "", "a | b | c\n" * 30, texts[5] + "\nHome | Shop | News | Jobs"]
    texts += [texts[7] + "\n" + items[1][1], prose(200, 77), prose(200, 77).replace("stone", "stones", 1)]
    docs = list(enumerate(texts))
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    p = quality_rules.QualityParams()
    kept = [(i, v[-1]) for i, t in docs if (v := quality_rules.judge(t, p))[6]]
    after = plain_line_dedup(kept, line_dedup.LineChunkParams())
    kept = [(i, after[i]) for i, t in kept if after[i].strip() or not t.strip()]
    groups = brute.components(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    import re

    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    kept = [(i, t) for i, t in kept if not any(brute.tiles(tokens(x), tokens(t), 5) >= 0.6 * len(tokens(x)) for _, x in items)]
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [i for i, _ in kept] and len(kept) > 15
    whole = encoding()
    for i, t in kept:
        assert got[i]["ids"] == whole.encode_ordinary(t)


def test_stages_take_empty_and_null_rows(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0)]):
        docs = spark.createDataFrame(rows, ddl)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == len(rows), name
        assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
