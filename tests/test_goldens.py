"""Small fixed cases of the operators."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import dense, dialogue, evidence, fusion, impact, knowledge, lexical, routing, structured, tables, text, writing
from paperloom.streaming import jobs as streams

CORPUS = [
    (1, "Sourdough loaves rise slowly in a cold oven"),
    (2, "Rye and spelt make a dense loaf, rye most of all"),
    (3, "The oven door stays shut until the crust is brown"),
    (4, "Butter, butter and more butter: notes on laminated dough"),
    (5, ""),
    (6, None),
    (7, "A brown crust, a brown crumb and a cold cellar"),
]


def test_bm25(spark):
    chunks = spark.createDataFrame(CORPUS, "chunk_id long, content string")
    asked = [(1, "sourdough"), (2, "rye loaf"), (3, "espresso"), (4, " "), (5, "Butter dough"), (6, "brown crust")]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    scored = lexical.bm25(questions, lexical.build_index(chunks))
    best = {q: [r["chunk_id"] for r in lexical.topk(scored, 2).where(f"question_id = {q}").orderBy("rank").collect()] for q, _ in asked}
    assert best == {1: [1], 2: [2], 3: [], 4: [], 5: [4], 6: [7, 3]}


def test_impact_search_equals_scoring_everything(spark):
    """The same best chunks from levels of impact; less than a third of the postings are read, and none is shuffled."""
    from paperloom.sources import views as V

    sf_dir = "/root/testdata/sf0.01"
    questions, docs = V.questions(spark, sf_dir), V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    index, told = impact.build_impact_index(docs), {}
    rows = lambda df: sorted((r["question_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    plain = lexical.bm25(questions, lexical.query_index(questions, docs)).withColumn("score", F.round("score", 8))
    assert rows(impact.impact_topk(questions, index, 10, told=told)) == rows(lexical.topk(plain, 10))
    whole = impact.question_weights(questions, index).select(F.explode("levels").alias("l")).agg(F.sum("l.n")).first()[0]
    assert told["cuts"].agg(F.sum("n")).first()[0] < whole / 3
    some = questions.where("question_id < 3")  # few results: no threshold, nothing is left out
    assert rows(impact.impact_topk(some, index, 2000)) == rows(lexical.topk(plain.where("question_id < 3"), 2000))
    read = impact._read(index, told["cuts"], "question_id", F.lit(True))
    plan = read._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and plan.index("paperloom_postings") < plan.index("Exchange")  # only the questions' terms


def test_terms_in_texts(spark):
    texts = [(1, "a graph of graphs, x"), (2, "paragraph"), (3, None), (4, ""), (5, "ab"), (6, "日本語の文"), (7, "%_ graph")] + [(10 + i, "common " * i) for i in range(9)]
    terms = ["graph", "graphs", "ab", "x", "本語", "の", "absent term", "", None, "common common", "_ g", "graph"]
    out = lexical.contained_terms(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), "k", "text")
    expected = sorted((k, t) for k, x in texts if x for t in {t for t in terms if t} if t in x)
    assert sorted(map(tuple, out.collect())) == expected


def test_catalog_is_met_by_terms(spark):
    catalog = spark.createDataFrame([(1, "Wind farms and GRU nets", 2020), (2, "wind", 2024), (3, None, None), (4, "A gru", 2024)], "paper_id long, text string, publish_year int")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id long, question string")
    terms = spark.createDataFrame([(1, "Wind"), (1, "GRU"), (1, "wind"), (2, "solar"), (9, "wind")], "question_id long, term string")
    rows = [(r["question_id"], r["paper_id"], r["score"], r["rank"]) for r in routing.discover_catalog(asked, terms, catalog, 2).collect()]
    assert sorted(rows) == [(1, 1, 3.0, 1), (1, 2, 2.0, 2), (3, 2, 1.2024, 1), (3, 4, 1.2024, 2)]
    assert "NestedLoop" not in routing.discover_catalog(asked, terms, catalog, 2)._jdf.queryExecution().toString()


def test_hits_and_papers(spark):
    """Profiles and summaries keep their own text; papers show a title and two best hits; reviews are demoted unless asked for."""
    ddl = "question_id long, hit_id long, source_type string, chunk_id long, paper_id long, section_type string, payload string, score double"
    hits = [(1, 1, "raw_chunk", 10, None, None, None, 0.9), (1, 2, "raw_chunk", 11, None, None, None, 0.8), (1, 3, "paper_profile", None, 2, None, "about it", 0.7), (1, 4, "section_summary", None, 1, "METHOD", None, 0.6), (1, 5, "paper_profile", None, None, None, "lost", 0.5), (1, 6, "raw_chunk", 99, None, None, None, 0.4)]
    chunks = spark.createDataFrame([(10, 1, "RESULT", "R", "text ten", False, False), (11, 1, "RESULT", "R", "text", True, False)], "chunk_id long, paper_id long, section_type string, section_title string, content string, is_reference boolean, is_noise boolean")
    papers = spark.createDataFrame([(1, "A Survey of bread"), (2, None)], "paper_id long, title string")
    out = {r["hit_id"]: (r["paper_id"], r["section_type"], r["content"], r["title"]) for r in fusion.hydrate(spark.createDataFrame(hits, ddl), chunks, papers).collect()}
    assert out == {1: (1, "RESULT", "text ten", "A Survey of bread"), 3: (2, None, "about it", "未知论文"), 4: (1, "METHOD", "", "A Survey of bread")}
    rows = spark.createDataFrame([(1, 1, 7, " ", 0.7), (1, 2, 7, "B", 0.9), (1, 3, 7, "C", 0.8), (1, 4, 8, None, None)], "question_id long, hit_id long, paper_id long, title string, score double")
    best = {r["paper_id"]: (r["title"], r["hits"], r["best"]) for r in fusion.aggregate_by_paper(rows, 5).collect()}
    assert best == {7: ("B", 3, [2, 3]), 8: ("未知论文", 1, [4])}
    found = spark.createDataFrame([(q, p, f"{t} of methods") for q in (1, 2, 3) for p, t in ((1, "A review"), (2, "A model"))], "question_id long, paper_id long, title string")
    asked = spark.createDataFrame([(1, "which method is it"), (2, "Any SURVEY on it"), (3, None)], "question_id long, question string")
    assert sorted(map(tuple, fusion.reviews_to_demote(found, asked).collect())) == [(1, 1), (3, 1)]


def test_corrections_and_refresh(spark):
    units = spark.createDataFrame([(i, i // 3, "METHOD", f"S{i % 2}", "uses", f"v{i}", "BRONZE", "LLM", "AUTO") for i in range(9)], "unit_id long, paper_id long, knowledge_type string, subject_text string, predicate_text string, object_value string, confidence_level string, extraction_method string, verification_status string")
    no = None
    events = spark.createDataFrame(
        [(1, 0, "CORRECT", " S9 ", no, "new", "ms", no, 1), (2, 0, "CORRECT", no, "has", "newer", " ", no, 2), (3, 0, "CONFIRM", no, no, no, no, no, 3), (4, 1, "CORRECT", "lost", no, " ", no, no, 4), (5, 4, "REJECT", no, no, no, no, no, 5), (6, 99, "CONFIRM", no, no, no, no, no, 6)],
        "event_id long, unit_id long, action string, subject_text string, predicate_text string, object_value string, value_unit string, applicable_condition string, ts int",
    )
    after = {r["unit_id"]: r for r in knowledge.corrected_units(units, events).collect()}
    assert len(after) == 9
    told = lambda r: tuple(r[c] for c in ("subject_text", "predicate_text", "object_value", "value_unit", "verification_status", "confidence_level", "extraction_method"))
    assert told(after[0]) == ("S9", "has", "newer", "ms", "CONFIRMED", "GOLD", "USER")
    assert told(after[1]) == ("S1", "uses", "v1", None, "AUTO", "BRONZE", "LLM") and told(after[4])[4:] == ("REJECTED", "BRONZE", "LLM")
    audit = {(r["event_id"], r["field"]): (r["before"], r["after"]) for r in knowledge.correction_audit(units, events).collect()}
    assert audit[1, "subject_text"] == ("S0", "S9") and audit[2, "object_value"] == ("new", "newer") and (2, "value_unit") not in audit
    assert audit[3, "verification_status"] == ("CORRECTED", "CONFIRMED") and not [k for k in audit if k[0] in (4, 6)]
    for build in (knowledge.build_catalog, lambda u: knowledge.flag_conflicts(u).select("paper_id", "unit_id", "conflict_group", "has_conflict")):
        fresh = knowledge.refreshed(build(units), units, events, build)
        assert sorted(map(str, fresh.collect())) == sorted(map(str, build(knowledge.corrected_units(units, events)).select(*fresh.columns).collect()))
    facts = spark.createDataFrame([(2, 1, "k1", "a", "EXTRACTED", 0.5, "g", 4), (1, 1, "k2", "b", "EXTRACTED", 0.5, "g", 9), (3, 1, "k3", "c", "EXTRACTED", 0.5, None, 1)], "fact_id long, paper_id long, fact_key string, fact_value string, verification_status string, confidence double, conflict_group string, page_number int")
    (row,) = knowledge.conflict_candidates(facts).collect()
    assert row["fact_key"] == "k1" and [c["fact_id"] for c in row["candidates"]] == [2, 1]
    notes = spark.createDataFrame([("dataset,loss", 0), ("", 2), (None, 0)], "m string, c int").select(F.size(knowledge.safe_defaults(F.col("m"), F.col("c"))).alias("n")).collect()
    assert [r["n"] for r in notes] == [2, 2, 1]


def test_clean_and_sections(spark):
    raw = "Abstract\nWe pro-\npose it.\r\n12\n1 Introduction\nIntro text.\n2 Proposed Method\nOur way.\n3 Experiments\nRuns.\nReferences\n[1] A\nConclusion\n[2] B"
    rows = spark.createDataFrame([(1, raw), (2, "only plain text here.\n\n\n\nand more."), (3, ""), (4, "Our System\nWe propose a module.")], "paper_id long, text string")
    out = text.sectionize(text.clean(rows)).orderBy("paper_id", "section_index").collect()
    assert [r["section_type"] for r in out if r["paper_id"] == 1] == ["ABSTRACT", "INTRODUCTION", "METHOD", "EXPERIMENT", "REFERENCES"]
    assert out[0]["content"] == "We propose it." and out[4]["content"].endswith("Conclusion\n[2] B")
    assert [(r["section_title"], r["content"]) for r in out if r["paper_id"] == 2] == [("Unknown", "only plain text here.\n\nand more.")]
    assert [(r["section_title"], r["section_type"]) for r in out if r["paper_id"] == 4] == [("Our System", "METHOD")]
    assert not [r for r in out if r["paper_id"] == 3]


def test_packing(spark):
    long = "x" * 5000
    content = "\n\n".join(["a" * 900, "b" * 600, "c" * 200, long, "d"])
    row = spark.createDataFrame([(content,)], "t string").select(text.pack_paragraphs(F.col("t")).alias("p")).first()["p"]
    assert [len(x) for x in row] == [1502, 200, 5000, 1]
    cut = spark.createDataFrame([(long,)], "t string").select(text.long_windows(F.col("t")).alias("w")).first()["w"]
    assert [len(x) for x in cut] == [2200, 2200, 1000]


def test_rrf_and_round_robin(spark):
    routes = spark.createDataFrame([(1, "a", "k1", 1), (1, "a", "k2", 2), (1, "b", "k2", 1), (1, "b", "k2", 4)], "question_id long, route string, key string, rank int")
    out = {r["key"]: r["rrf"] for r in fusion.rrf(routes, 5).collect()}
    assert out == {"k1": round(1 / 61, 10), "k2": round(1 / 62 + 1 / 64, 10)}
    hits = [(1, p, f"{kind}{p}{i}", kind, score, p * 10 + i, False, 0) for p in (1, 2, 3) for i, (kind, score) in enumerate((("paper_profile", 0.5), ("raw_chunk", 0.9), ("section_summary", 0.7)))]
    df = spark.createDataFrame(hits, "question_id long, paper_id long, key string, source_type string, score double, hit_id long, background boolean, matches int")
    ranked = spark.createDataFrame([(1, p, p) for p in (1, 2, 3)], "question_id long, paper_id long, rank int")
    dealt = [r["key"] for r in fusion.round_robin(df, ranked, 7).orderBy("pos").collect()]
    assert dealt[:6] == ["paper_profile10", "paper_profile20", "paper_profile30", "section_summary12", "section_summary22", "section_summary32"]
    assert dealt[6] == "raw_chunk11"


def test_history_budget(spark):
    turns = [(1, i, "q" * 10, "a" * 26) for i in range(4)]
    df = spark.createDataFrame(turns, "session_id long, msg_id long, question string, answer string")
    assert tuple(dialogue.fit_history(df, 200).first())[1:] == (2, 2, 200, False)
    assert tuple(dialogue.fit_history(df, 199).first())[1:3] == (1, 3)
    assert dialogue.fit_history(df, 99).first()["too_small"]
    msgs = [(1, 0, "assistant", "x"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", " "), (1, 4, "assistant", "b"), (1, 5, "user", "end")]
    pairs = dialogue.pair_turns(spark.createDataFrame(msgs, "session_id long, msg_id long, role string, content string")).collect()
    assert [(p["question"], p["answer"]) for p in pairs] == [("q", "a")]


def test_facts(spark):
    chunk = [(1, 5, 0, "METHOD", "We use a learning rate of 0.001 and batch size 32.", False, False), (2, 5, 1, "METHOD", "Learning rate = 0.01 later; batch size: 32", False, False), (3, 5, 2, "REFERENCES", "batch size 8", True, False)]
    df = spark.createDataFrame(chunk, "chunk_id long, paper_id long, chunk_index int, section_type string, content string, is_reference boolean, is_noise boolean")
    merged = knowledge.fact_conflicts(knowledge.merge_facts(knowledge.mine_hyperparameters(df))).collect()
    found = {(r["logical"].split("|")[1], r["value"]): (r["support"], r["conflict_group"] is not None) for r in merged}
    assert found == {("learning_rate", "0.001"): (1, True), ("learning_rate", "0.01"): (1, True), ("batch_size", "32"): (2, False)}


def test_fulltext_budget(spark):
    rows = [(i, 1, i, s, "t", "w" * n, False, False) for i, (s, n) in enumerate([("A", 40), ("A", 400), ("A", 40), ("B", 40), ("C", 400), ("D", 4)])]
    df = spark.createDataFrame(rows, "chunk_id long, paper_id long, chunk_index int, section_type string, section_title string, content string, is_reference boolean, is_noise boolean")
    assert evidence.fulltext_context(df, 50).first()["chunk_ids"] == [0, 3]


def test_ids_and_upsert(spark):
    row = spark.createDataFrame([("3, x,,-1,3,7",)], "t string").select(tables.parse_ids(F.col("t")).alias("p"), tables.normalize_ids(tables.parse_ids(F.col("t"))).alias("n")).first()
    assert row["p"] == [3, -1, 3, 7] and row["n"] == [3, 7]
    old = spark.createDataFrame([(1, 10, "a"), (2, 11, "b")], "k long, id long, v string")
    new = spark.createDataFrame([(2, 90, "B"), (3, 91, "C")], "k long, id long, v string")
    assert sorted(map(tuple, tables.upsert_versioned(old, new, ["k"], "id").collect())) == [(1, 10, "a"), (2, 11, "B"), (3, 91, "C")]


def test_stored_tables(spark, tmp_path):
    """Rebuilt partitions leave the files of others; exports keep order; a manifest tells what lies there; searches prune."""
    rows = spark.createDataFrame([(i, f"k{i % 4}", f"line {i}") for i in range(40)], "id long, kind string, line string")
    rows.write.partitionBy("kind").parquet(f"{tmp_path}/t")
    files = lambda: {(r["kind"], r["f"]) for r in spark.read.parquet(f"{tmp_path}/t").select("kind", F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    tables.rebuild_partitions(rows.where("kind = 'k1' AND id < 20"), f"{tmp_path}/t", "kind")
    assert {x for x in before if x[0] != "k1"} == {x for x in files() if x[0] != "k1"} and not {x for x in before if x[0] == "k1"} & files()
    assert spark.read.parquet(f"{tmp_path}/t").where("kind = 'k1'").count() == 5
    tables.export_json(rows.orderBy(F.rand(3)), f"{tmp_path}/j", ["kind", "id"])
    parts = sorted(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json")
    told = [json.loads(x) for p in parts for x in p.read_text().splitlines()]
    assert [(x["kind"], x["id"]) for x in told] == sorted((f"k{i % 4}", i) for i in range(40)) and len(parts) > 1
    tables.export_texts(rows, f"{tmp_path}/x", "kind", "line", 4)
    out = tables.exported_manifest(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{tmp_path}/x"), "kind").collect()
    for r in out:
        raw = open(r["path"].removeprefix("file:"), "rb").read()
        assert (r["bytes"], r["lines"], r["digest"]) == (len(raw), raw.count(b"\n"), hashlib.sha256(raw).hexdigest()) and r["lines"] <= 4
    assert sum(r["lines"] for r in out) == 40
    vectors = spark.createDataFrame([(i, i, f"k{i % 4}", [float(i), 1.0]) for i in range(40)], "point_id long, paper_id long, content_type string, embedding array<float>")
    dense.store_by_type(vectors, f"{tmp_path}/v")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    found = dense.stored_topk(asked, f"{tmp_path}/v", ("k2", "kx"), 3)
    assert sorted(r["point_id"] for r in found.collect()) == [30, 34, 38]
    assert "PartitionFilters: [content_type#" in found._jdf.queryExecution().toString()
    read = spark.read.parquet(f"{tmp_path}/v").where(F.col("content_type").isin("k2", "kx")).select("_metadata.file_path").distinct().collect()
    assert read and all("content_type=k2" in r["file_path"] for r in read)


def test_sketches_of_parts(spark):
    runs = spark.range(20000).select((F.col("id") % 3).alias("stage"), (F.col("id") % 7).alias("day"), F.col("id").cast("double").alias("ms"))
    kept = dialogue.latency_sketches(runs, "stage", F.col("day"), "ms")
    assert kept.count() == 21
    for r in dialogue.sketched_stats(kept, "stage").collect():
        assert abs(r["p50_ms"] - 10000) < 500 and abs(r["p95_ms"] - 19000) < 500 and abs(r["avg_ms"] - 10000) < 5
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("term"), F.col("id") % 2000)).alias("content"))
    (row,) = lexical.sketched_report(lexical.term_sketches(chunks, F.col("chunk_id") % 5)).collect()
    assert (row["indexed"], row["skipped"]) == (2700, 300) and abs(row["terms"] - 1800) < 60


def test_section_types(spark):
    cases = {"Abstract": "ABSTRACT", "4.1. Experimental results": "EXPERIMENT", "Results": "RESULT", "参考文献": "REFERENCES", "IV. Discussion": "DISCUSSION", "Zebra": "UNKNOWN", "": "UNKNOWN", "Acknowledgments": "BACK_MATTER"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.section_type_from_title(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases


def files_of(df, n, path):
    """``df`` in n files of rows by the remainder of their id, in order."""
    for i in range(n):
        df.where(F.col(df.columns[0]) % n == i).coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batches(spark, tmp_path):
    ts = datetime.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], float(i), ts + datetime.timedelta(hours=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, stage string, ms double, ts timestamp")
    files_of(df, 4, f"{tmp_path}/in/spans")
    stream = lambda name, like: spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{name}")
    for name, delay, whole in (("late", "60 days", True), ("short", "1 hour", False)):
        query = streams.run_changes(streams.windowed_timings(stream("spans", df), "2 days", "1 day", delay), f"{tmp_path}/{name}", f"{tmp_path}/ck_{name}")
        got = sorted(map(tuple, streams.read_changes(spark, f"{tmp_path}/{name}", ("stage", "start")).collect()))
        assert (got == sorted(map(tuple, streams.windowed_timings(df, "2 days", "1 day").collect()))) == whole
        assert (streams.dropped_rows(query) == 0) == whole  # the files are dealt, so each holds rows of all days
    job = df.select(F.col("event_id").alias("job_id"), (F.col("event_id") % 7).alias("paper_id"), F.col("stage").alias("status"), F.lit(0).cast("long").alias("processed"), F.lit(1).cast("long").alias("total"), F.col("ts").alias("create_time"))
    files_of(job, 3, f"{tmp_path}/in/jobs")
    last = job.where("job_id = 57").withColumns({"job_id": F.lit(90).cast("long"), "create_time": F.lit(ts + datetime.timedelta(days=90))})
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/jobs")
    streams.run_changes(dialogue.latest_jobs(stream("jobs", job)), f"{tmp_path}/latest", f"{tmp_path}/ck2")
    final = streams.read_changes(spark, f"{tmp_path}/latest", ("paper_id",)).select("paper_id", "job_id", "status", "processed", "total")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, dialogue.latest_jobs(job.unionByName(last)).collect()))
    assert spark.read.parquet(f"{tmp_path}/latest/batch=3").count() == 1  # one key came, one row is written
    events = df.select("event_id", (F.col("event_id") % 5).alias("unit_id"), F.when(F.col("event_id") % 3 == 0, "CORRECT").otherwise("CONFIRM").alias("action"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("v"), "event_id")).alias("object_value"), "ts")
    files_of(events, 4, f"{tmp_path}/in/feedback")
    streams.run_changes(knowledge.apply_feedback(stream("feedback", events)), f"{tmp_path}/feedback", f"{tmp_path}/ck3")
    got = streams.read_changes(spark, f"{tmp_path}/feedback", ("unit_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knowledge.apply_feedback(events).collect()))


def test_ingest_keeps_the_newest_version(spark, tmp_path):
    """Segments equal the index of the newest texts; papers come twice, a batch is repeated, small segments are merged."""
    body = lambda p, v: f"Abstract\nPaper {p} tells of words{v} and words{p}.\n\n" + "More text follows here. " * (p + v)
    batches = [[(p, v) for p in some] for v, some in enumerate(((1, 2, 3, 4), (2, 5), (6,), (2, 3), (7, 8)))]
    for n, papers in enumerate(batches):
        rows = [(p, f"T{p}", body(p, v), v) for p, v in papers] + ([(2, "T2", "", 0)] if n == 3 else [])  # an older version comes late
        frame = spark.createDataFrame(rows, "paper_id long, title string, text string, version int")
        for _ in range(1 + (n == 2)):
            streams.add_segment(frame, n, f"{tmp_path}/index")
    newest = {p: v for papers in batches for p, v in papers}
    whole = spark.createDataFrame([(p, f"T{p}", body(p, v)) for p, v in newest.items()], "paper_id long, title string, text string")
    chunks = text.build_chunks(text.sectionize(text.clean(whole)), whole)
    expected = lexical.postings(chunks.withColumn("chunk_id", F.struct("paper_id", "chunk_index"))).select("chunk_id.paper_id", "chunk_id.chunk_index", "term", "tf", "doc_len")
    got = streams.read_postings(spark, f"{tmp_path}/index").select("paper_id", "chunk_index", "term", "tf", "doc_len")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    live = streams.segments(spark, f"{tmp_path}/index")
    assert live[0][0] == 0 and live[-1][1] == 4 and len(live) < 5
    assert all(b[0] == a[1] + 1 for a, b in zip(live, live[1:]))
    assert streams.merged_tail([100, 8, 3, 1]) == 1 and streams.merged_tail([100, 8, 2, 3]) == 3


def test_ingest_evaluates_texts_once_and_leaves_large_segments(spark):
    """A line is lower-cased once, a title bared once, a text cleaned once, spaces are kept; large segments are not merged."""
    frame = spark.createDataFrame([(1, "T", "Abstract\nA  b\tc.\n\n\n\nd\u00a0e \x0b f\n\ng h"), (2, "T", " \n\n "), (3, "T", None), (4, "T", "References\nResults\nMethod")], "paper_id long, title string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.clean(frame)).count("lower(") == 1
    assert plan(frame.select(T.section_type_from_title(F.col("text")).alias("kind"))).count("lower(") == 1
    sections = text.sectionize(text.clean(frame))
    assert plan(sections).count("{3,}") == 1
    assert [tuple(r) for r in sections.select("paper_id", "section_index", "section_type", "content").orderBy("paper_id", "section_index").collect()] == [
        (1, 0, "ABSTRACT", "A b c.\n\nd\u00a0e \x0b f\n\ng h"),
        (4, 0, "REFERENCES", "Results\nMethod"),
    ]
    assert text.build_chunks(sections, frame).where("paper_id = 1").first()["content"] == "A b c.\n\nd\u00a0e f\n\ng h"
    assert streams.merged_tail([200 << 20, 100 << 20]) == 1 and streams.merged_tail([150 << 20, 100 << 20]) == 2


def test_quantised_search_reaches_its_recall(spark):
    """Nine tenths of the exact best five are found with full comparisons of at most a tenth of the pairs."""
    from paperloom.sources import views as V

    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        queries, vectors = V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir)
        book = dense.fit_codebook(vectors)
        exact = {(r["query_id"], r["point_id"]) for r in dense.cosine_topk(queries, vectors, 5).collect()}
        got = {(r["query_id"], r["point_id"]) for r in dense.pq_topk(queries, vectors, dense.quantize(vectors, book), book, 5, 40).collect()}
        assert len(got & exact) >= 0.9 * len(exact) and 40 <= vectors.count() / 10


def test_approximate_search_reaches_its_recall(spark):
    """Nine tenths of the exact best five are found, by lists and by buckets; the lists compare about half of all pairs."""
    from paperloom.sources import views as V

    queries, vectors = V.vector_queries(spark, "/root/testdata/sf0.01"), V.vectors(spark, "/root/testdata/sf0.01")
    exact = {(r["query_id"], r["point_id"]) for r in dense.cosine_topk(queries, vectors, 5).collect()}
    model = dense.fit_lists(vectors)
    for found in (dense.ivf_topk(queries, vectors, model, 5, 32), dense.lsh_topk(queries, vectors, 5)):
        got = {(r["query_id"], r["point_id"]) for r in found.collect()}
        assert len(got & exact) >= 0.9 * len(exact)
    compared = dense.ivf_topk(queries, vectors, model, vectors.count(), 32).count()
    assert compared <= 0.7 * queries.count() * vectors.count()


def test_routes(spark):
    asked = [
        (1, "Which data set was used", [4], ("SINGLE", "DATASET", "KNOWLEDGE_UNIT", "HIGH", "DATASET,INPUT_VARIABLE")),
        (2, "How do the methods differ", [4, 5, 4], ("MULTI", "METHOD", "KNOWLEDGE_UNIT", "HIGH", "METHOD,MODEL_COMPONENT")),
        (3, "What is the trend of late", [], ("LIBRARY", "DISCOVERY", "PAPER_CATALOG", "MEDIUM", "")),
        (4, "有没有更新颖的", [0, -1], ("LIBRARY", "FUZZY", "PAPER_CATALOG", "LOW", "")),
        (5, "the weakness of this model", [1], ("SINGLE", "LIMITATION", "KNOWLEDGE_UNIT", "HIGH", "LIMITATION")),
        (6, "which problem does the dataset show", [1], ("SINGLE", "RESEARCH_TASK", "PAPER_PROFILE", "HIGH", "RESEARCH_TASK,RESEARCH_PROBLEM")),
        (7, None, None, ("LIBRARY", "OVERVIEW", "PAPER_PROFILE", "MEDIUM", "")),
    ]
    rows = spark.createDataFrame([x[:3] for x in asked], "question_id long, question string, paper_ids array<long>")
    plans = routing.route_questions(rows)
    got = {r["question_id"]: (r["scope"], r["intent"], r["layer"], r["confidence"], ",".join(r["types"])) for r in plans.collect()}
    assert got == {x[0]: x[3] for x in asked}
    raw = [(1, '{"intent":"why","knowledgeTypes":["comparison","nonsense"],"confidence":0.91}'), (2, "not-json"), (3, '{"knowledgeTypes":["METHOD"],"confidence":0.3}'), (4, ""), (5, '{"confidence":2}'), (6, '{"knowledgeTypes":[],"confidence":0.9}')]
    merged = {r["question_id"]: (r["router_source"], r["fallback_reason"], ",".join(r["types"])) for r in routing.merge_routes(plans, spark.createDataFrame(raw, "question_id long, raw string")).collect()}
    assert merged[1] == ("MODEL", None, "DATASET,INPUT_VARIABLE,COMPARISON") and merged[7][0] == "RULE"
    assert [merged[i][1] for i in range(2, 7)] == ["NOT_JSON", "LOW_CONFIDENCE", "NO_ANSWER", "BAD_CONFIDENCE", "NO_LABEL"]


def test_structured_evidence(spark):
    """A sure unit needs no section; a gap takes the section that fills it; what nothing covers is retrieved."""
    plans = spark.createDataFrame([(1, "MULTI", "KNOWLEDGE_UNIT", "HIGH", ["METHOD", "DATASET"], ["METHOD"]), (2, "SINGLE", "PAPER_PROFILE", "LOW", [], [])], "question_id long, scope string, layer string, confidence string, types array<string>, sections array<string>")
    candidates = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 10, 0)], "question_id long, paper_id long, paper_pos int")
    units = spark.createDataFrame([(1, 10, "METHOD", "GOLD", False), (2, 10, "DATASET", "SILVER", False), (3, 11, "METHOD", "GOLD", True)], "unit_id long, paper_id long, knowledge_type string, confidence_level string, has_conflict boolean")
    summaries = spark.createDataFrame([(100, 10, "METHOD"), (110, 11, "METHODS"), (111, 11, "INTRODUCTION")], "section_id long, paper_id long, section_type string")
    found = spark.createDataFrame([(1, 10, 1, "METHOD", 1), (1, 11, 2, "METHOD", 2), (2, 10, 3, "RESULT", 1)], "question_id long, paper_id long, chunk_id long, section_type string, rank int")
    rows, decisions = structured.structured_evidence(plans, candidates, spark.createDataFrame([(10,)], "paper_id long"), units, summaries, found, 3)
    keys = {q: [r["key"] for r in rows.where(f"question_id = {q}").orderBy("pos").collect()] for q in (1, 2)}
    assert keys == {1: ["knowledge:1", "knowledge:2", "knowledge:3", "summary:110"], 2: ["profile:10", "chunk:3"]}
    assert {r["question_id"]: (r["supplement"], r["reason"]) for r in decisions.collect()} == {1: (False, None), 2: (True, "VAGUE")}


def test_fields_of_model_output(spark):
    said = "intro\n## 1. **研究问题**： What is\nasked?\n- 方法概述: none\n实验与评估\n 信 \n主要贡献：\n完整画像：all of it"
    row = writing.extract_fields(spark.createDataFrame([(said,), ("nothing",), (None,)], "text string"), ("研究问题", "方法概述", "实验与评估", "主要贡献", "完整画像")).collect()
    assert [f["value"] for f in row[0]["fields"]] == ["What is\nasked?", "none", "信", "信息不足", "all of it"]
    assert [f["value"] for f in row[1]["fields"]] == ["信息不足"] * 4 + ["nothing"]


def test_outlines_and_restored_revisions(spark):
    raw = [(1, '{"sections":[{"heading":" A ","sourcePaperIds":[1]},{"heading":""},{"heading":"B"}]}', [1, 2], 900), (2, '{"sections":[{"heading":"A","sourcePaperIds":[9]}]}', [1], 100), (3, "oops", None, 3000)]
    out = writing.parse_outlines(spark.createDataFrame(raw, "project_id long, raw string, allowed_ids array<long>, target_words int")).orderBy("project_id", "pos").collect()
    assert [(r["heading"], r["words"]) for r in out if r["project_id"] == 1] == [("A", 450), ("B", 450)]
    assert [len([r for r in out if r["project_id"] == i]) for i in (2, 3)] == [5, 5] and out[-1]["words"] == 600
    rows = spark.createDataFrame([(1, 1, "NEW", "a", 1), (1, 2, "EDIT", "b", 2), (2, 7, "NEW", "c", 1)], "project_id long, revision_id long, kind string, content string, create_time int")
    chosen = spark.createDataFrame([(1, 1, 9), (1, 7, 9)], "project_id long, revision_id long, at int")
    after = writing.restore_revisions(rows, chosen).where("kind = 'VERSION_RESTORED'").collect()
    assert [(r["project_id"], r["revision_id"], r["content"]) for r in after] == [(1, 3, "a")]
    assert [r["revision_id"] for r in writing.revisions(rows).where("project_id = 1").orderBy("pos").collect()] == [2, 1]


def test_discovery_deals_over_papers(spark):
    """Three papers found alike give one row each before any gives a second; an unrewritten question has two routes."""
    kinds = ("paper_profile", "section_summary", "raw_chunk")
    routes = [(1, f"dense_{n}", kind, p * 10 + k, 1.0 / p, p) for n in (0, 1) for k, kind in enumerate(kinds) for p in (1, 2, 3)]
    df = spark.createDataFrame(routes, "question_id long, route string, source_type string, chunk_id long, score double, rank int")
    meta = spark.createDataFrame([(p * 10 + k, p, f"T{p}", "Method", "a graph of words" if p < 3 else "words") for p in (1, 2, 3) for k in range(3)], "chunk_id long, paper_id long, title string, section_title string, content string")
    asked = spark.createDataFrame([(1, "tell about graphs")], "question_id long, question string")
    terms = spark.createDataFrame([(1, "graph"), (1, "words")], "question_id long, term string")
    out = fusion.discover(df, meta, asked, terms, 6).orderBy("pos").collect()
    assert [r["paper_id"] for r in out[:3]] == [1, 2, 3] and all(r["key"].startswith("paper_profile") for r in out[:3])
    assert [r["key"] for r in out[3:6]] == ["section_summary:11", "section_summary:21", "section_summary:31"]
    near = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "question_id long, chunk_id long, rank int")
    none = near.limit(0)
    fused = {r["key"]: r["rrf"] for r in fusion.hybrid_retrieve(near, none, near.where("chunk_id = 6"), 5).collect()}
    assert fused == {5: round(1 / 61, 10), 6: round(2 / 62, 10)}


def test_scoped_search_ranks_rounded_scores(spark):
    """Scores that differ by less than 8 places (sums in another order) are ties, which go by chunk; so says the SQL."""
    posts = spark.createDataFrame([(1, "rye", 1, 4), (2, "rye", 1, 4), (3, "rye", 1, 9)], "chunk_id long, term string, tf long, doc_len long")
    # The first chunk's score is a hair smaller than the second's.
    posts = posts.withColumn("doc_len", F.when(F.col("chunk_id") == 1, F.lit(4.0000000001)).otherwise(F.col("doc_len").cast("double")))
    stats = spark.createDataFrame([(3, 5.0)], "n long, avgdl double")
    index = lexical.LexicalIndex(posts, lexical.doc_freq(posts), stats)
    chunks = spark.createDataFrame([(i, 7, False, False) for i in (1, 2, 3)], "chunk_id long, paper_id long, is_reference boolean, is_noise boolean")
    asked = spark.createDataFrame([(1, "rye")], "question_id long, question string")
    for mode in ("pre", "post"):
        assert [r["chunk_id"] for r in lexical.bm25_scoped(asked, index, chunks, None, 1, mode).collect()] == [1]


def test_structured_evidence_has_a_short_plan(spark):
    """Steps that are read again are written: the plan had 11,209 lines, as each path held all steps before it."""
    from paperloom.plans import registry

    df = registry.QUERIES["f19_structured_evidence"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("\n") < 300
