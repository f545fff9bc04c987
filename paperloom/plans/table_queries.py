"""Registered queries over table maintenance, conversations, writing and telemetry (A, G, H, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators import dialogue as D
from paperloom.operators import tables as A
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, listed, over, trimmed
from paperloom.sources import views as V
from paperloom.sources.scratch import shared_folder, written


@query(over("SELECT p.paper_id, p.category_id, coalesce(p.publish_year, 0) AS publish_year, c.name FROM paper_rows p LEFT JOIN categories c USING (category_id) WHERE p.category_id = 3", "paper_rows", "categories"))
def a1_scan_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan_papers(V.paper_rows(spark, sf_dir), V.categories(spark, sf_dir), 3).select("paper_id", "category_id", F.coalesce("publish_year", F.lit(0)).alias("publish_year"), "name")


@query(over("SELECT chunk_id, paper_id, section_type FROM chunks WHERE paper_id % 5 <> 0 UNION ALL SELECT chunk_id + 1000000, paper_id, 'NEW' FROM chunks WHERE paper_id % 5 = 0 AND chunk_index < 2", "chunks"))
def a2_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = V.chunks(spark, sf_dir).select("chunk_id", "paper_id", "section_type")
    new = V.chunks(spark, sf_dir).where("paper_id % 5 = 0 AND chunk_index < 2").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "paper_id", F.lit("NEW").alias("section_type"))
    return A.replace_by_key(old, new, "paper_id")


@query(over("SELECT chunk_id, paper_id, section_type FROM chunks WHERE section_type <> 'METHOD' UNION ALL SELECT chunk_id + 1000000, paper_id, section_type FROM chunks WHERE section_type = 'METHOD' AND paper_id % 2 = 0", "chunks"))
def a2_rebuild_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section's partition of a stored table is written anew."""
    path = f"{shared_folder(spark)}/chunks"
    rows = V.chunks(spark, sf_dir).select("chunk_id", "paper_id", "section_type")
    rows.write.partitionBy("section_type").parquet(path)
    A.rebuild_partitions(rows.where("section_type = 'METHOD' AND paper_id % 2 = 0").withColumn("chunk_id", F.col("chunk_id") + 1000000), path, "section_type")
    return spark.read.parquet(path).select("chunk_id", "paper_id", "section_type")


@query(
    over(
        """SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, coalesce(o.id, n.id) AS id, CASE WHEN n.summary IS NOT NULL THEN n.summary ELSE o.summary END AS summary FROM
  (SELECT paper_id, chunk_index, chunk_id AS id, 'old ' || chunk_id AS summary FROM chunks WHERE chunk_id % 3 <> 0) o FULL JOIN (SELECT paper_id, chunk_index, chunk_id + 5000000 AS id, 'new ' || chunk_id AS summary FROM chunks WHERE chunk_id % 2 = 0) n
  ON o.paper_id = n.paper_id AND o.chunk_index = n.chunk_index""",
        "chunks",
    )
)
def a3_upsert_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.chunks(spark, sf_dir)
    old = c.where("chunk_id % 3 <> 0").select("paper_id", "chunk_index", F.col("chunk_id").alias("id"), F.concat(F.lit("old "), "chunk_id").alias("summary"))
    new = c.where("chunk_id % 2 = 0").select("paper_id", "chunk_index", (F.col("chunk_id") + 5000000).alias("id"), F.concat(F.lit("new "), "chunk_id").alias("summary"))
    return A.upsert_versioned(old, new, ["paper_id", "chunk_index"], "id")


_LIVE = "paper_id NOT IN (SELECT paper_id FROM paper_rows WHERE parse_status = 'FAILED')"


@query(over(f"SELECT 'chunks' AS name, chunk_id AS id FROM chunks WHERE {_LIVE} UNION ALL SELECT 'units', unit_id FROM units WHERE {_LIVE} UNION ALL SELECT 'vectors', point_id FROM vectors WHERE {_LIVE} UNION ALL SELECT 'papers', paper_id FROM paper_rows WHERE parse_status <> 'FAILED'", "chunks", "units", "vectors", "paper_rows"))
def a4_j19_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper's chunks, facts and vectors go with it."""
    papers = V.paper_rows(spark, sf_dir)
    tables = {"chunks": (V.chunks(spark, sf_dir), "chunk_id"), "units": (V.units(spark, sf_dir), "unit_id"), "vectors": (V.vectors(spark, sf_dir), "point_id"), "papers": (papers, "paper_id")}
    left, out = A.cascade_delete({name: t for name, (t, _) in tables.items()}, papers.where("parse_status = 'FAILED'")), None
    for name, rows in left.items():
        rows = rows.select(F.lit(name).alias("name"), F.col(tables[name][1]).alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(over("SELECT paper_id, CASE WHEN category_id IN (SELECT category_id FROM categories) THEN category_id ELSE 1 END AS category_id FROM paper_rows", "paper_rows", "categories"))
def a5_repair_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repair_category(V.paper_rows(spark, sf_dir), V.categories(spark, sf_dir), 1).select("paper_id", "category_id")


@query(over("SELECT category_id, name FROM categories UNION ALL SELECT category_id + 1000, 'new ' || name FROM categories WHERE category_id % 2 = 0", "categories"))
def a6_ensure_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.categories(spark, sf_dir)
    default = c.where("category_id % 2 = 0").withColumns({"name": F.concat(F.lit("new "), "name"), "category_id": F.col("category_id") + 1000})
    return A.ensure_default(c, default.unionByName(c.where("category_id % 3 = 0"))).select("category_id", "name")


@query(over("SELECT paper_id, CASE WHEN category_id IN (SELECT category_id FROM categories WHERE NOT system_flag AND category_id < 5) THEN 1 ELSE category_id END AS category_id FROM paper_rows", "paper_rows", "categories"))
def a7_retire_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.categories(spark, sf_dir)
    return A.retire_categories(V.paper_rows(spark, sf_dir), c, c.where("category_id < 5"), 1)[0].select("paper_id", "category_id")


@query(over("SELECT category_id, name, count(p.paper_id) AS papers FROM categories c LEFT JOIN paper_rows p USING (category_id) GROUP BY 1, 2", "categories", "paper_rows"))
def a8_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_counts(V.categories(spark, sf_dir), V.paper_rows(spark, sf_dir)).select("category_id", "name", "papers")


@query(over("SELECT 'new ' || name AS name, (SELECT max(sort_order) FROM categories) + 10 * row_number() OVER (ORDER BY 'new ' || name) AS sort_order FROM categories WHERE category_id % 2 = 0", "categories"))
def a9_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.categories(spark, sf_dir)
    new = c.where("category_id % 2 = 0").select(F.concat(F.lit("new "), "name").alias("name"))
    return A.allocate_sort_order(new, c).select("name", "sort_order")


@query(over("SELECT paper_id, CASE WHEN publish_year NOT BETWEEN 1000 AND 2100 THEN 'year out of range' ELSE 'journal too long' END AS problem FROM (SELECT p.*, d.text AS journal FROM paper_rows p JOIN documents d ON d.doc_id = (p.paper_id - 1) * 6) WHERE publish_year NOT BETWEEN 1000 AND 2100 OR length(trim(journal, chr(10) || ' ')) > 500", "paper_rows"))
def a10_validate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper's first text stands for its journal, so that some are too long."""
    d = V.table(spark, sf_dir, "documents").where("doc_id % 6 = 0").select((F.floor(F.col("doc_id") / 6) + 1).alias("paper_id"), F.col("text").alias("journal"))
    rows = V.paper_rows(spark, sf_dir).join(d, "paper_id")
    return rows.select("paper_id", A.metadata_problem(F.col("title"), F.col("publish_year"), F.col("journal")).alias("problem")).where("problem IS NOT NULL")


_ID_LIST = "list_filter(list_transform(string_split(raw, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)), lambda x: x IS NOT NULL AND x > 0)"


@query(f"SELECT doc_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ',') AS ids FROM (SELECT doc_id, {_ID_LIST} AS ids FROM (SELECT doc_id, regexp_replace(md5(text), '[a-f]', ' , ', 'g') || ',x,7,7,-3' AS raw FROM documents))")
def a11_a12_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of numbers, blanks and words made of a digest of every whole text."""
    raw = F.concat(F.regexp_replace(F.md5("text"), "[a-f]", " , "), F.lit(",x,7,7,-3"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.normalize_ids(A.parse_ids(raw)), ",").alias("ids"))


@query(over("SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'UNKNOWN' ELSE section_type END AS section_type, md5(content) AS digest, CAST(ceil(length(content) / 4.0) AS BIGINT) AS token_count, length(content) AS char_count FROM chunks", "chunks"))
def a13_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    rows = V.chunks(spark, sf_dir).withColumns({"section_type": F.when(F.col("chunk_id") % 2 != 0, F.col("section_type")), "index_text": null("string"), "token_count": null("long"), "char_count": null("long")})
    return A.backfill_chunks(rows).select("chunk_id", "section_type", F.md5("index_text").alias("digest"), "token_count", "char_count")


_KINDS = ("paper_profile", "section_summary", "raw_chunk")


@query(over("SELECT p.paper_id, count(*) FILTER (WHERE content_type = 'paper_profile') AS paper_profile, count(*) FILTER (WHERE content_type = 'section_summary') AS section_summary, count(*) FILTER (WHERE content_type = 'raw_chunk') AS raw_chunk FROM paper_rows p LEFT JOIN vectors v USING (paper_id) GROUP BY 1", "paper_rows", "vectors"))
def a16_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.index_status(V.vectors(spark, sf_dir), V.paper_rows(spark, sf_dir), _KINDS).drop("complete")


@query("SELECT 'doc-' || doc_id || '.md' AS path, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def a18_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("p"), "text")
    return A.manifest(files, "p", "text")


@query(over("SELECT section_type, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM (SELECT section_type, '> ' || replace(content, chr(10), ' ') AS line FROM chunks WHERE NOT is_reference AND content IS NOT NULL) GROUP BY 1", "chunks"))
def a18_export_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts as lines of text files below a folder for each section; told by the manifest of what lies there."""
    path = f"{shared_folder(spark)}/excerpts"
    line = F.concat(F.lit("> "), F.replace("content", F.lit("\n"), F.lit(" ")))
    rows = V.chunks(spark, sf_dir).where("NOT is_reference AND content IS NOT NULL").select("section_type", line.alias("line"))
    A.export_texts(rows, path, "section_type", "line")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    out = A.exported_manifest(files, "section_type")
    return out.groupBy("section_type").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@query(over("SELECT paper_id, CASE WHEN n IN (SELECT lower(name) FROM categories) THEN 'taken' ELSE 'twice' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY n) AS c FROM (SELECT paper_id, 'src' || (paper_id % 150) AS n FROM paper_rows)) WHERE c > 1 OR n IN (SELECT lower(name) FROM categories)", "paper_rows", "categories"))
def a19_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = V.paper_rows(spark, sf_dir).select("paper_id", F.concat(F.lit(" SRC"), F.col("paper_id") % 150).alias("name"))
    return A.check_unique_names(new, V.categories(spark, sf_dir), "paper_id")


# --- conversations

add_view("recent", ("chat",), "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS b, count(*) OVER (PARTITION BY session_id) > 4 AS has_more FROM chat) WHERE b <= 4")
add_view(
    "turns",
    ("chat",),
    "SELECT session_id, msg_id, content AS question, answer FROM (SELECT *, lead(role) OVER w AS nxt, lead(content) OVER w AS answer FROM chat WINDOW w AS (PARTITION BY session_id ORDER BY msg_id)) WHERE role = 'user' AND nxt = 'assistant' AND trim(content) <> '' AND trim(answer) <> ''",
)


@query(over("SELECT session_id, msg_id, pos, has_more FROM recent", "recent"))
def g1_recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recent_messages(V.chat(spark, sf_dir), 4).select("session_id", "msg_id", F.col("pos").cast("long").alias("pos"), "has_more")


@query(over("SELECT session_id, msg_id, md5(question) AS q, md5(answer) AS a FROM turns", "turns"))
def g2_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pair_turns(V.chat(spark, sf_dir)).select("session_id", "msg_id", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@query(
    over(
        "SELECT session_id, count(*) FILTER (WHERE t <= 2500) AS kept, count(*) FILTER (WHERE t > 2500) AS omitted, CAST(coalesce(max(t) FILTER (WHERE t <= 2500), 0) AS BIGINT) AS used, count(*) FILTER (WHERE t <= 2500) = 0 AS too_small FROM "
        "(SELECT *, sum(strlen(question) + strlen(answer) + 64) OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS t FROM turns) GROUP BY 1",
        "turns",
    )
)
def g3_fit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fit_history(D.pair_turns(V.chat(spark, sf_dir)), 2500)


@query(over(f"""SELECT session_id, string_agg(role || ': ' || substr({trimmed("regexp_replace(content, '\\s+', ' ', 'g')")}, 1, 500), chr(10) ORDER BY msg_id) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY msg_id DESC) AS b FROM chat) WHERE b <= 6 GROUP BY 1""", "chat"))
def g5_history_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.history_snippet(V.chat(spark, sf_dir))


@query("SELECT item_id, substr(text, 1, 400) AS rewrite FROM benchmark")
def g6_clean_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.table(spark, sf_dir, "benchmark")
    return b.select("item_id", D.clean_rewrite(F.concat(F.lit('```text\nQuery: "'), "text", F.lit('"\n```'))).alias("rewrite"))


@query(over("SELECT session_id, arg_min(substr(content, 1, 30), msg_id) FILTER (WHERE role = 'user') AS title, max(msg_id) AS last, count(*) AS messages FROM chat GROUP BY 1", "chat"))
def g7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sessions(V.chat(spark, sf_dir))


# --- jobs

add_view("last_jobs", ("jobs",), "SELECT paper_id, job_id, status, processed, total FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY create_time DESC, job_id DESC) AS n FROM jobs) WHERE n = 1")


@query(over("SELECT * FROM last_jobs", "last_jobs"))
def h7_latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latest_jobs(V.jobs(spark, sf_dir))


@query(over("SELECT p.paper_id, p.title, coalesce(u.units, 0) AS units, coalesce(j.status, 'NONE') AS job_status FROM paper_rows p LEFT JOIN (SELECT paper_id, count(*) AS units FROM units GROUP BY 1) u USING (paper_id) LEFT JOIN last_jobs j USING (paper_id)", "paper_rows", "units", "last_jobs"))
def h8_profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.units(spark, sf_dir).groupBy("paper_id").agg(F.count("*").alias("units"))
    last = D.latest_jobs(V.jobs(spark, sf_dir)).select("paper_id", F.col("status").alias("job_status"))
    rows = V.paper_rows(spark, sf_dir).join(n, "paper_id", "left").join(last, "paper_id", "left")
    return rows.select("paper_id", "title", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("job_status", F.lit("NONE")).alias("job_status"))


@query(over("SELECT job_id, paper_id, CASE WHEN total > 0 THEN 5 + 75 * processed // total ELSE 5 END AS percent, row_number() OVER (PARTITION BY paper_id ORDER BY create_time, job_id) - 1 AS retries FROM jobs", "jobs"))
def h9_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.job_progress(V.jobs(spark, sf_dir))


@query(over("SELECT paper_id, failed, done, CASE WHEN failed = 0 THEN 'COMPLETED' WHEN done > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS outcome FROM (SELECT paper_id, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status <> 'FAILED') AS done FROM jobs GROUP BY 1)", "jobs"))
def h11_batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.batch_outcome(V.jobs(spark, sf_dir), "paper_id")


# --- writing

add_view("drafts", (), "SELECT doc_id AS project_id, text || ' [P' || (doc_id % 7) || ']' || chr(10) || chr(10) || '# Heading of the next part of this text' || chr(10) || chr(10) || 'Known from [P' || (doc_id % 5) || '] and [P999].' AS content FROM documents")
add_view("marks", ("drafts",), "SELECT project_id, generate_subscripts(l, 1) - 1 AS pos, CAST(unnest(l) AS BIGINT) AS paper_id FROM (SELECT project_id, regexp_extract_all(content, '\\[P(\\d+)\\]', 1) AS l FROM drafts)")
add_view("allowed", (), "SELECT doc_id AS project_id, unnest(range(0, 5)) AS paper_id FROM documents")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.concat(F.lit(" [P"), i % 7, F.lit("]\n\n# Heading of the next part of this text\n\nKnown from [P"), i % 5, F.lit("] and [P999]."))
    return V.table(spark, sf_dir, "documents").select(i.alias("project_id"), F.concat("text", tail).alias("content"))


@query(over("SELECT * FROM marks", "marks"))
def k5_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.citations(_drafts(spark, sf_dir), "project_id")


@query(
    over(
        f"""SELECT d.project_id, coalesce(valid, 0) AS valid, coalesce(invalid, 0) + CASE WHEN d.project_id % 6 = 0 THEN 1 ELSE 0 END AS invalid, d.project_id % 6 = 0 AS warned, array_to_string(list_filter(range(0, 5), lambda x: NOT list_contains(cited, x)), ',') AS uncited, coalesce(papers, 0) AS papers, len(ps) AS paragraphs, CASE WHEN len(ps) > 0 THEN round(100.0 * len(list_filter(ps, lambda x: regexp_matches(x, '\\[P(\\d+)\\]'))) / len(ps), 1) ELSE 0.0 END AS coverage
  FROM (SELECT project_id, list_filter(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: length({trimmed("x")}) >= 40 AND NOT starts_with({trimmed("x")}, '#')) AS ps FROM drafts) d
  LEFT JOIN (SELECT m.project_id, count(a.paper_id) AS valid, count(*) - count(a.paper_id) AS invalid, count(DISTINCT a.paper_id) AS papers, list(DISTINCT m.paper_id) AS cited FROM marks m LEFT JOIN allowed a ON a.project_id = m.project_id AND a.paper_id = m.paper_id GROUP BY 1) c USING (project_id)""",
        "drafts",
        "marks",
        "allowed",
    )
)
def k7_audit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("paper_id"))
    docs = _drafts(spark, sf_dir).withColumn("content", F.when(F.col("project_id") % 6 == 0, F.concat("content", F.lit(rules.MISSING_SOURCE))).otherwise(F.col("content")))
    return D.audit_citations(docs, allowed, "project_id").withColumn("uncited", F.array_join("uncited", ","))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{Han}')) + len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS words FROM documents")
def k12_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", D.word_count(F.col("text")).alias("words"))


# --- telemetry

_STAGES = ("click", "view", "purchase", "error")
_SUMS = ", ".join(f"round(coalesce(sum(ms) FILTER (WHERE stage = '{s}'), 0.0), 4) AS {s}" for s in (*_STAGES, "signup"))
_KNOWN = " + ".join(_STAGES)
add_view(
    "rollup",
    ("spans",),
    f"""SELECT request_id, {", ".join(_STAGES)}, round(greatest(signup, {_KNOWN}), 4) AS total_ms, round(round(greatest(signup, {_KNOWN}), 4) - ({_KNOWN}), 4) AS other_ms,
  CASE greatest({", ".join(_STAGES)}) {" ".join(f"WHEN {s} THEN '{s}'" for s in _STAGES)} END AS dominant FROM (SELECT request_id, {_SUMS} FROM spans GROUP BY 1)""",
)


@query(over("SELECT request_id, dominant, round(total_ms, 2) AS total_ms, round(other_ms, 2) + 0.0 AS other_ms FROM rollup", "rollup"))
def l1_timing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.timing_rollup(V.spans(spark, sf_dir), _STAGES, "signup")
    return out.select("request_id", "dominant", F.round("total_ms", 2).alias("total_ms"), (F.round("other_ms", 2) + 0.0).alias("other_ms"))


@query(over(f"SELECT request_id, stage, round(100 * ms / total_ms, 1) AS percent FROM (UNPIVOT (SELECT request_id, total_ms, {', '.join(_STAGES)} FROM rollup) ON {', '.join(_STAGES)} INTO NAME stage VALUE ms) WHERE ms > 0", "rollup"))
def l2_timing_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.timing_shares(D.timing_rollup(V.spans(spark, sf_dir), _STAGES, "signup"), _STAGES).select("request_id", "stage", "percent")


@query(over("SELECT stage, count(*) AS runs, round(avg(ms), 4) AS avg_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM spans GROUP BY 1", "spans"))
def l3_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latency_stats(V.spans(spark, sf_dir), "stage", "ms")


@query(over("SELECT stage, count(*) AS runs, round(avg(ms), 4) AS avg_ms, true AS close FROM spans GROUP BY 1", "spans"))
def l3_sketch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sketches by day; ``close``: the estimates lie between the exact quantiles 2.5 % of ranks away."""
    spans = V.spans(spark, sf_dir)
    kept = written(D.latency_sketches(spans, "stage", F.to_date("ts"), "ms"))
    exact = spans.groupBy("stage").agg(F.percentile("ms", F.array(*[F.lit(q) for q in (0.475, 0.525, 0.925, 0.975)])).alias("q"))
    both = D.sketched_stats(kept, "stage").join(exact, "stage")
    close = F.col("p50_ms").between(F.col("q")[0], F.col("q")[1]) & F.col("p95_ms").between(F.col("q")[2], F.col("q")[3])
    return both.select("stage", "runs", F.round("avg_ms", 4).alias("avg_ms"), close.alias("close"))


@query(
    over(
        """SELECT g.question_id, round(coalesce(h.hit, 0) / g.gold, 6) AS recall, round(CASE WHEN f.found > 0 THEN coalesce(h.hit, 0) / f.found ELSE 0.0 END, 6) AS precision FROM (SELECT question_id, count(*) AS gold FROM gold GROUP BY 1) g
  LEFT JOIN (SELECT question_id, count(*) AS found FROM topped GROUP BY 1) f USING (question_id) LEFT JOIN (SELECT question_id, count(*) AS hit FROM topped JOIN gold USING (question_id, chunk_id) GROUP BY 1) h USING (question_id)""",
        "gold",
        "topped",
    )
)
def l5_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.plans.search_queries import c6_bm25_topk

    return D.retrieval_metrics(c6_bm25_topk(spark, sf_dir), V.gold(spark, sf_dir))


@query(over("SELECT stage AS metric, round(b - a, 2) AS delta, a > 50 OR b >= 49 AS passed FROM (SELECT stage, avg(ms) FILTER (WHERE event_id % 2 = 0) AS a, avg(ms) FILTER (WHERE event_id % 2 = 1) AS b FROM spans GROUP BY 1)", "spans"))
def l7_metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("ms")))
    m = V.spans(spark, sf_dir).groupBy(F.col("stage").alias("metric")).agg(half(0).alias("baseline"), half(1).alias("final"))
    return D.metric_gates(m.withColumn("target", F.when(F.col("baseline") <= 50, F.lit(49.0))))
