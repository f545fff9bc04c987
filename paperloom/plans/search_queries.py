"""Registered queries over the lexical index, vectors, fusion and paper ranking (C, D, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import tokens
from paperloom.operators import dense, fusion, impact, lexical
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, choice, listed, over, quoted
from paperloom.sources import views as V
from paperloom.sources.scratch import shared_folder, written

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {p}), lambda w: length(w) >= 2 AND NOT list_contains([{s}], w))"


def tokens_sql(x: str) -> str:
    return _TOKENS.format(x=x, p=quoted(rules.TOKEN_SPLIT), s=listed(rules.STOPWORDS))


add_view("docs", (), "SELECT doc_id AS chunk_id, text AS content FROM documents")
add_view("toks", ("docs",), f"SELECT chunk_id, {tokens_sql('content')} AS tokens FROM docs")
add_view("postings", ("toks",), "SELECT chunk_id, doc_len, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM toks) GROUP BY ALL")
add_view("doc_freq", ("postings",), "SELECT term, count(*) AS df FROM postings GROUP BY term")
add_view("stats", ("toks",), "SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks WHERE len(tokens) > 0")
add_view("qterms", ("questions",), f"SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({tokens_sql('question')}) AS term FROM questions) GROUP BY ALL")
add_view(
    "scored",
    ("postings", "doc_freq", "stats", "qterms"),
    f"""SELECT question_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * ({rules.K1} + 1) * tf / ({rules.K1} * (1 - {rules.B} + {rules.B} * doc_len / avgdl) + tf)) AS score
  FROM postings JOIN doc_freq USING (term) JOIN qterms USING (term) CROSS JOIN stats GROUP BY ALL""",
)
add_view("topped", ("scored",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 8) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@query(over("SELECT chunk_id, list_aggregate(tokens, 'string_agg', ' ') AS tokens FROM toks WHERE len(tokens) > 0", "toks"))
def c1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("chunk_id", tokens(F.col("content")).alias("t")).where(F.size("t") > 0).select("chunk_id", F.array_join("t", " ").alias("tokens"))


@query(over("SELECT chunk_id, term, tf, doc_len FROM postings", "postings"))
def c2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(_docs(spark, sf_dir)).select("chunk_id", "term", "tf", "doc_len")


@query(over("SELECT * FROM doc_freq", "doc_freq"))
def c3_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.doc_freq(lexical.postings(_docs(spark, sf_dir)))


@query(over("SELECT n, round(avgdl, 6) AS avgdl FROM stats", "stats"))
def c4_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_docs(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(over("SELECT question_id, chunk_id, CAST(floor(score * 1000) AS BIGINT) AS milli_score FROM scored", "scored"))
def c5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = V.questions(spark, sf_dir)
    out = lexical.bm25(questions, lexical.query_index(questions, _docs(spark, sf_dir)))
    return out.select("question_id", "chunk_id", F.floor(F.col("score") * 1000).alias("milli_score"))


def _topped(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = V.questions(spark, sf_dir)
    return lexical.bm25_topk(questions, lexical.query_index(questions, _docs(spark, sf_dir)), 10)


@query(over("SELECT question_id, chunk_id, rank FROM topped", "topped"))
def c6_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topped(spark, sf_dir).select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(over("SELECT question_id, chunk_id, rank FROM topped", "topped"))
def c6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stored index, without what cannot reach the tenth score."""
    index = impact.build_impact_index(_docs(spark, sf_dir))
    return impact.impact_topk(V.questions(spark, sf_dir), index, 10).select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def _scoped(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    meta = V.chunks(spark, sf_dir).where("paper_id % 3 = 0")
    return lexical.bm25_scoped(V.questions(spark, sf_dir), lexical.build_index(_docs(spark, sf_dir)), meta, None, 10, mode).select("question_id", "chunk_id", "paper_id")


@query(over("SELECT question_id, chunk_id, paper_id FROM topped JOIN chunks USING (chunk_id) WHERE NOT is_reference AND NOT is_noise AND paper_id % 3 = 0", "topped", "chunks"))
def c7_scoped_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scope for all questions: a filter of the chunks."""
    return _scoped(spark, sf_dir, "post")


@query(
    over(
        "SELECT question_id, chunk_id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 8) DESC, chunk_id) AS r FROM scored JOIN chunks USING (chunk_id) "
        "WHERE NOT is_reference AND NOT is_noise AND paper_id % 3 = 0) WHERE r <= 10",
        "scored",
        "chunks",
    )
)
def c7_scoped_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir, "pre")


@query(over("SELECT count(*) FILTER (WHERE len(tokens) > 0) AS indexed, count(*) FILTER (WHERE len(tokens) = 0) AS skipped, (SELECT count(*) FROM doc_freq) AS terms FROM toks", "toks", "doc_freq"))
def c8_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.index_report(_docs(spark, sf_dir))


@query(over("SELECT count(*) FILTER (WHERE len(tokens) > 0) AS indexed, count(*) FILTER (WHERE len(tokens) = 0) AS skipped, true AS close FROM toks", "toks"))
def c8_sketch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sketches of ten parts; ``close``: the terms are within 5 % of the exact number."""
    kept = written(lexical.term_sketches(_docs(spark, sf_dir), F.col("chunk_id") % 10))
    exact = lexical.index_report(_docs(spark, sf_dir)).select(F.col("terms").alias("exact"))
    both = lexical.sketched_report(kept).crossJoin(F.broadcast(exact))  # a row each
    return both.select("indexed", "skipped", (F.abs(F.col("terms") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


# --- dense

_H = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c + 2147483648) % 4294967296 - 2147483648)"


@query(
    f"""SELECT doc_id, round(least(1.0, length(text) / 1000.0), 6) AS e1, round(h % 100 / 100.0, 6) AS e2, round(length(text) * 3 % 100 / 100.0, 6) AS e3, round((h % 97 + 1) / 100.0, 6) AS e4
  FROM (SELECT doc_id, text, abs({_H.replace("2147483648) % 4294967296", "2147483648 + 4294967296 * 16) % 4294967296")}) AS h FROM documents)"""
)
def d1_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", dense.hash_embed(F.col("text")).alias("e"))
    return d.select("doc_id", *[F.round(F.element_at("e", i), 6).alias(f"e{i}") for i in (1, 2, 3, 4)])


@query(
    """SELECT coalesce(d.doc_id, e.vec_id) AS key, CASE WHEN d.doc_id IS NULL THEN 'no text' WHEN d.text IS NULL THEN 'null text' WHEN e.vec_id IS NULL OR e.embedding IS NULL THEN 'no vector' ELSE 'dimension' END AS problem
  FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR d.text IS NULL OR e.vec_id IS NULL OR e.embedding IS NULL OR len(e.embedding) <> 64"""
)
def d2_validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    vectors = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    return dense.validate_vectors(texts, vectors, 64, "key")


_COS = "round(list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 8)"


def _nearest(where: str, parts: str) -> str:
    body = f"SELECT query_id, point_id, content_type, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {parts} ORDER BY score DESC, point_id) AS r FROM (SELECT query_id, point_id, paper_id, content_type, {_COS} AS score FROM vectors CROSS JOIN vector_queries {where})) WHERE r <= 5"
    return over(body, "vectors", "vector_queries")


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "point_id", "content_type", F.round("score", 5).alias("score"))


@query(_nearest("", "query_id"))
def d3_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(dense.cosine_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 5))


@query(_nearest("WHERE content_type = 'raw_chunk' AND paper_id IN (1, 2, 3, 5, 8, 13, 21)", "query_id"))
def d4_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.vectors(spark, sf_dir).where((F.col("content_type") == "raw_chunk") & F.col("paper_id").isin(1, 2, 3, 5, 8, 13, 21))
    return _found(dense.cosine_topk(V.vector_queries(spark, sf_dir), part, 5))


@query(_nearest("WHERE content_type <> 'paper_profile'", "query_id"))
def d4_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors lie by content type; two of three types are searched."""
    path = f"{shared_folder(spark)}/vectors"
    dense.store_by_type(V.vectors(spark, sf_dir), path)
    return _found(dense.stored_topk(V.vector_queries(spark, sf_dir), path, ("section_summary", "raw_chunk"), 5))


@query(_nearest("", "query_id, content_type"))
def d5_topk_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(dense.cosine_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 5, by_type=True))


@query(
    over(
        f"""SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM (SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS r
  FROM (SELECT query_id, point_id, {_COS} AS score FROM vectors CROSS JOIN vector_queries)) WHERE r <= 20 AND point_id IN (SELECT unit_id FROM units WHERE verification_status <> 'REJECTED')""",
        "vectors",
        "vector_queries",
        "units",
    )
)
def d6_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.cosine_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 20)
    facts = V.units(spark, sf_dir).withColumnRenamed("unit_id", "point_id")
    return dense.recheck_facts(found, facts).select("query_id", "point_id", F.col("rank").cast("long").alias("rank"))


@query(over("SELECT unit_id, concat_ws(chr(10), knowledge_type, subject_text, object_value, evidence_text) AS fact_text FROM units", "units"))
def d7_fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.units(spark, sf_dir).select("unit_id", dense.fact_text("knowledge_type", "subject_text", "object_value", "evidence_text").alias("fact_text"))


@query()
def d8_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.lsh_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 5)


@query()
def d8_ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of 64 lists: the test vectors have no near neighbours, so fewer lists would miss some."""
    vectors = V.vectors(spark, sf_dir)
    return dense.ivf_topk(V.vector_queries(spark, sf_dir), vectors, dense.fit_lists(vectors), 5, 32)


@query()
def d8_pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised codes; 40 vectors of each query are compared in full."""
    vectors = V.vectors(spark, sf_dir)
    book = dense.fit_codebook(vectors)
    return dense.pq_topk(V.vector_queries(spark, sf_dir), vectors, dense.quantize(vectors, book), book, 5, 40)


# --- hits


def _near_sql(queries: str, n: int) -> str:
    return f"SELECT query_id AS question_id, point_id AS chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS r FROM (SELECT query_id, point_id, {_COS} AS score FROM vectors CROSS JOIN {queries})) WHERE r <= {n}"


ROUTE_NAMES = ("dense", "rewritten", "lexical")
add_view("near_asked", ("vectors", "vector_queries"), _near_sql("vector_queries", 10))
add_view("near_rewritten", ("vectors", "vector_queries2"), _near_sql("vector_queries2", 10))
add_view(
    "hits",
    ("topped", "near_asked", "near_rewritten"),
    f"""SELECT question_id, {choice(ROUTE_NAMES, "r")} AS route, {choice(V.VECTOR_TYPES, "chunk_id % 3")} AS source_type, chunk_id // 6 + 1 AS paper_id, chunk_id, round(score, 6) AS score, chunk_id * 3 + r AS hit_id FROM (
  SELECT question_id, chunk_id, 0 AS r, score FROM near_asked UNION ALL SELECT question_id, chunk_id, 1, score FROM near_rewritten UNION ALL SELECT question_id, chunk_id, 2, round(score, 8) FROM topped)""",
)


def _near(spark: SparkSession, sf_dir: str, at: int, n: int) -> DataFrame:
    out = dense.cosine_topk(V.vector_queries(spark, sf_dir, at), V.vectors(spark, sf_dir), n)
    return out.select(F.col("query_id").alias("question_id"), F.col("point_id").alias("chunk_id"), "score", "rank")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three routes find for the questions in all documents and vectors: the text, the question's vector and a rewritten one's."""
    routes = (_near(spark, sf_dir, 0, 10), _near(spark, sf_dir, 50, 10), _topped(spark, sf_dir))
    found = None
    for r, rows in enumerate(routes):
        rows = rows.select("question_id", "chunk_id", F.lit(r).alias("r"), "score")
        found = rows if found is None else found.unionByName(rows)
    c = F.col("chunk_id")
    rows = found.select(
        "question_id", V.pick(ROUTE_NAMES, F.col("r")).alias("route"), V.pick(V.VECTOR_TYPES, c % 3).alias("source_type"), (F.floor(c / 6) + 1).alias("paper_id"), "chunk_id", F.round("score", 6).alias("score"), (c * 3 + F.col("r")).alias("hit_id")
    )
    return written(rows)


# --- fusion

add_view("routed", ("hits",), "SELECT *, source_type || ':' || chunk_id AS key, row_number() OVER (PARTITION BY question_id, route ORDER BY score DESC, hit_id) AS rank FROM hits")
add_view(
    "fused",
    ("routed",),
    f"SELECT question_id, key, round(sum(1.0 / ({rules.RRF_K} + rank)), 10) AS rrf FROM (SELECT question_id, key, route, max(rank) AS rank FROM routed GROUP BY ALL) GROUP BY ALL",
)


@query(over("SELECT question_id, key, round(rrf, 8) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, key) AS r FROM fused) WHERE r <= 10", "fused"))
def e2_e3_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = fusion.ranked_routes(_hits(spark, sf_dir)).withColumn("key", fusion.source_key())
    return fusion.rrf(routes, 10).select("question_id", "key", F.round("rrf", 8).alias("rrf"))


@query(
    over(
        """SELECT h.hit_id, h.question_id, h.chunk_id, coalesce(p.title, 'Unknown') AS title, h.section_type, h.content FROM (
  SELECT hit_id, question_id, chunk_id, c.paper_id, c.section_type, md5(c.content) AS content FROM hits h JOIN chunks c USING (chunk_id) WHERE source_type = 'raw_chunk' AND NOT c.is_reference AND NOT c.is_noise
  UNION ALL SELECT hit_id, question_id, chunk_id, paper_id, CASE WHEN source_type = 'section_summary' THEN 'SUMMARY' END, md5(CASE WHEN chunk_id % 5 = 0 THEN '' ELSE source_type || ' of ' || chunk_id END) FROM hits WHERE source_type <> 'raw_chunk') h LEFT JOIN paper_rows p ON p.paper_id = h.paper_id""".replace("Unknown", rules.UNKNOWN_TITLE),
        "hits",
        "chunks",
        "paper_rows",
    )
)
def e1_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their text, profiles and summaries with the text that the hit carries; some carry none."""
    payload = F.when(F.col("chunk_id") % 5 != 0, F.concat("source_type", F.lit(" of "), "chunk_id"))
    hits = _hits(spark, sf_dir).withColumns({"payload": payload, "section_type": F.lit("SUMMARY")})
    rows = fusion.hydrate(hits, V.chunks(spark, sf_dir), V.paper_rows(spark, sf_dir))
    return rows.select("hit_id", "question_id", "chunk_id", "title", "section_type", F.md5("content").alias("content"))


@query(
    over(
        f"""SELECT question_id, key, round(rrf, 8) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, key) AS r FROM (
  SELECT question_id, key, round(sum(1.0 / ({rules.RRF_K} + rank)), 10) AS rrf FROM (SELECT question_id, chunk_id AS key, 'lexical' AS route, rank FROM topped
    UNION ALL SELECT question_id, chunk_id, 'dense', rank FROM near_asked UNION ALL SELECT question_id, chunk_id, 'rewritten', rank FROM near_rewritten WHERE question_id % 3 > 0) GROUP BY ALL)) WHERE r <= 5""",
        "topped",
        "near_asked",
        "near_rewritten",
    )
)
def e4_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three routes; a third of the questions were not rewritten, so that they have two."""
    again = _near(spark, sf_dir, 50, 10).where("question_id % 3 > 0")
    out = fusion.hybrid_retrieve(_near(spark, sf_dir, 0, 10), again, _topped(spark, sf_dir), 5)
    return out.select("question_id", "key", F.round("rrf", 8).alias("rrf"))


add_view("variant_terms", ("questions",), f"SELECT DISTINCT question_id, unnest({tokens_sql('question')}) AS term FROM questions")


@query()
def e5_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of each question, each searched by type; the text's hits join the raw pool."""
    variants = None
    for n, at in enumerate((0, 50)):
        found = dense.cosine_topk(V.vector_queries(spark, sf_dir, at), V.vectors(spark, sf_dir), 10, by_type=True)
        found = found.select(F.col("query_id").alias("question_id"), F.lit(f"dense_{n}").alias("route"), F.col("content_type").alias("source_type"), F.col("point_id").alias("chunk_id"), "score", "rank")
        variants = found if variants is None else variants.unionByName(found)
    lex = _topped(spark, sf_dir).select("question_id", F.lit("bm25").alias("route"), F.lit("raw_chunk").alias("source_type"), "chunk_id", "score", "rank")
    meta = V.chunks(spark, sf_dir).select("chunk_id", "paper_id", "section_title", "content").join(V.paper_rows(spark, sf_dir).select("paper_id", "title"), "paper_id", "left")
    return fusion.discover(variants.unionByName(lex), meta, _asked(spark, sf_dir), _hit_terms(spark, sf_dir), 6).withColumn("pos", F.col("pos").cast("long"))


add_view(
    "by_paper",
    ("hits",),
    """SELECT question_id, paper_id, hits, round(hits / max(hits) OVER (PARTITION BY question_id) * 0.5 + max_score * 0.5, 8) AS score, max_score FROM (
  SELECT question_id, paper_id, count(*) AS hits, coalesce(max(score), 0.0) AS max_score FROM hits GROUP BY ALL)""",
)


@query(
    over(
        f"""SELECT b.question_id, b.paper_id, b.hits, round(b.score, 7) AS score, coalesce(t.title, '{rules.UNKNOWN_TITLE}') AS title, best FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, paper_id) AS r FROM by_paper) b
  JOIN (SELECT question_id, paper_id, string_agg(hit_id, ',' ORDER BY n) AS best FROM (SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY score DESC, hit_id) AS n FROM hits) WHERE n <= 2 GROUP BY ALL) USING (question_id, paper_id)
  LEFT JOIN (SELECT question_id, h.paper_id, arg_min(title, hit_id) AS title FROM hits h JOIN paper_rows p ON p.paper_id = h.paper_id WHERE hit_id % 2 = 0 GROUP BY ALL) t USING (question_id, paper_id) WHERE r <= 5""",
        "by_paper",
        "hits",
        "paper_rows",
    )
)
def e7_aggregate_by_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with title and two best hits; half of the hits carry a blank title."""
    hits = _hits(spark, sf_dir).join(V.paper_rows(spark, sf_dir).select("paper_id", "title"), "paper_id", "left")
    hits = hits.withColumn("title", F.when(F.col("hit_id") % 2 == 0, F.col("title")).otherwise(" "))
    return fusion.aggregate_by_paper(hits, 5).select("question_id", "paper_id", "hits", F.round("score", 7).alias("score"), "title", F.array_join("best", ",").alias("best"))


_WEIGHT = "CASE source_type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in rules.TYPE_WEIGHTS) + " END"
add_view("hit_terms", ("questions",), f"SELECT question_id, term FROM (SELECT question_id, unnest({tokens_sql('question')}) AS term FROM questions) GROUP BY ALL")
add_view("hit_texts", ("hits", "chunks", "paper_rows"), "SELECT h.*, coalesce(p.title, '') AS title, c.content FROM hits h JOIN chunks c USING (chunk_id) LEFT JOIN paper_rows p ON p.paper_id = h.paper_id")
add_view(
    "coverage",
    ("hit_texts", "hit_terms"),
    """SELECT question_id, paper_id, count(DISTINCT term) / any_value(n) AS coverage FROM (SELECT h.question_id, h.paper_id, t.term, t.n FROM hit_texts h
  JOIN (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM hit_terms) t ON t.question_id = h.question_id AND contains(lower(h.title || ' ' || h.content), t.term)
  WHERE h.source_type <> 'paper_profile') GROUP BY ALL""",
)
add_view(
    "ranked",
    ("hits", "coverage", "paper_rows"),
    f"""SELECT question_id, paper_id, score, covered_types, coverage, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, paper_id) AS rank FROM (
  SELECT question_id, paper_id, covered_types, coverage, round(CASE WHEN review THEN greatest(0.0, s - {rules.REVIEW_PENALTY}) ELSE s END, 8) AS score FROM (
    SELECT b.question_id, b.paper_id, covered_types, coalesce(c.coverage, 0.0) AS coverage, p.title LIKE '%survey%' AND b.question_id % 5 <> 0 AS review,
      base + greatest(0, covered_types - 1) * {rules.CROSS_TYPE_BONUS} + coalesce(c.coverage, 0.0) * {rules.COVERAGE_WEIGHT} AS s FROM (
      SELECT question_id, paper_id, sum({_WEIGHT} * least(1.0, (best + {rules.SECOND_HIT_WEIGHT} * second) / top)) AS base, count(*) FILTER (WHERE top > 0) AS covered_types FROM (
        SELECT *, max(best) OVER (PARTITION BY question_id, source_type) AS top FROM (
          SELECT question_id, paper_id, source_type, max(score) FILTER (WHERE n = 1) AS best, coalesce(max(score) FILTER (WHERE n = 2), 0.0) AS second FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id, paper_id, source_type ORDER BY score DESC) AS n FROM hits) GROUP BY ALL)) GROUP BY ALL) b
    LEFT JOIN coverage c USING (question_id, paper_id) LEFT JOIN paper_rows p ON p.paper_id = b.paper_id))""",
)


def _hit_texts(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    chunks = V.chunks(spark, sf_dir).select("chunk_id", "content")
    titles = V.paper_rows(spark, sf_dir).select("paper_id", "title")
    return hits.join(chunks, "chunk_id").join(titles, "paper_id", "left")


def _hit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.questions(spark, sf_dir).select("question_id", F.explode(tokens(F.col("question"))).alias("term")).distinct()


def _ranked(spark: SparkSession, sf_dir: str, top: int, hits: DataFrame) -> DataFrame:
    coverage = fusion.term_coverage(_hit_texts(spark, sf_dir, hits), _hit_terms(spark, sf_dir))
    # A fifth of the questions ask for surveys themselves; so do those that only vectors stand for.
    asked = hits.select("question_id").distinct().select("question_id", F.when(F.col("question_id") % 5 == 0, "a Survey of it").otherwise("how is it done").alias("question"))
    reviews = fusion.reviews_to_demote(hits.join(V.paper_rows(spark, sf_dir), "paper_id"), asked)
    return fusion.rank_papers(hits, top, coverage, reviews)


@query(over("SELECT question_id, paper_id, round(coverage, 6) AS coverage FROM coverage", "coverage"))
def e9_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.term_coverage(_hit_texts(spark, sf_dir, _hits(spark, sf_dir)), _hit_terms(spark, sf_dir))
    return out.select("question_id", "paper_id", F.round("coverage", 6).alias("coverage"))


@query(over("SELECT question_id, paper_id, covered_types, round(score, 6) AS score, rank FROM ranked WHERE rank <= 8", "ranked"))
def e8_e10_rank_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 8, _hits(spark, sf_dir)).select("question_id", "paper_id", "covered_types", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = V.pick(("which paper is it", "the only one", "which papers use it", "tell about it"), F.col("question_id") % 4)
    return V.questions(spark, sf_dir).select("question_id", F.concat_ws(" ", phrase, "question").alias("question"))


@query(
    over(
        f"""SELECT question_id, paper_id, rank FROM (SELECT r.*, max(score) OVER (PARTITION BY r.question_id) AS top, row_number() OVER (PARTITION BY r.question_id ORDER BY coverage DESC, score DESC, paper_id) AS best, k FROM (SELECT *, question_id % 4 AS k FROM ranked WHERE rank <= 8) r
  WHERE question_id IN (SELECT question_id FROM questions)) WHERE CASE k WHEN 1 THEN best = 1 WHEN 0 THEN rank <= 3 AND (score >= top * 0.75 OR rank <= 1) WHEN 2 THEN rank <= 3 AND (score >= top * 0.75 OR rank <= 1) ELSE rank <= {rules.DEFAULT_POLICY[1]} AND (score >= top * {rules.DEFAULT_POLICY[2]} OR rank <= 1) END""",
        "ranked",
        "questions",
    )
)
def e11_select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.select_candidates(_ranked(spark, sf_dir, 8, _hits(spark, sf_dir)), _asked(spark, sf_dir), 8).withColumn("rank", F.col("rank").cast("long"))


_BACK = " OR ".join(f"contains(t, {quoted(m)})" for m in rules.BACKGROUND_MARKS)
_DIRECT = " OR ".join(f"contains(t, {quoted(m)})" for m in rules.DIRECT_MARKS)
add_view(
    "judged",
    ("hit_texts", "hit_terms", "chunks"),
    f"""SELECT h.* EXCLUDE (title, content), ({_BACK}) AND NOT ({_DIRECT}) AS background, (SELECT count(*) FROM hit_terms q WHERE q.question_id = h.question_id AND contains(lower(h.title || ' ' || t), q.term)) AS matches
  FROM (SELECT x.*, lower(c.section_title || ' ' || c.content) AS t FROM hit_texts x JOIN chunks c USING (chunk_id)) h""",
)
add_view("rr0", ("judged", "ranked"), """SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY score DESC NULLS LAST, hit_id) - 1 AS place FROM (
  SELECT h.*, h.source_type || ':' || h.chunk_id AS key, r.rank AS paper_rank, row_number() OVER (PARTITION BY h.question_id, h.paper_id, h.source_type, h.chunk_id ORDER BY h.score DESC, h.hit_id) AS n
  FROM judged h JOIN ranked r ON r.question_id = h.question_id AND r.paper_id = h.paper_id AND r.rank <= 4) WHERE n = 1""")  # fmt: skip
add_view("rr1", ("rr0",), "SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY CASE WHEN source_type = 'paper_profile' THEN 0 ELSE 1 END, place) = 1 AS first FROM rr0")
add_view("rr2", ("rr1",), """SELECT *, CASE WHEN first THEN 1 WHEN source_type <> 'paper_profile' AND row_number() OVER (PARTITION BY question_id, paper_id ORDER BY CASE WHEN source_type = 'paper_profile' OR first THEN 1 ELSE 0 END,
  background, matches DESC, CASE WHEN source_type = 'section_summary' THEN 2 ELSE 1 END DESC, score DESC, hit_id) = 1 THEN 2 ELSE 3 END AS phase FROM rr1""")  # fmt: skip
add_view("rr3", ("rr2",), "SELECT question_id, coalesce(min(CASE WHEN added = 0 THEN place END), max(place) + 1) AS stop FROM (SELECT question_id, place, count(*) FILTER (WHERE phase = 3) AS added FROM rr2 GROUP BY ALL) GROUP BY ALL")


@query(
    over(
        "SELECT question_id, pos, paper_id, key FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY phase, CASE WHEN phase = 3 THEN place ELSE 0 END, paper_rank) AS pos FROM rr2 JOIN rr3 USING (question_id) WHERE phase < 3 OR place < stop) WHERE pos <= 12",
        "rr3",
    )
)
def e12_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    chunks = V.chunks(spark, sf_dir).select("chunk_id", "section_title", "content")
    texts = hits.join(chunks, "chunk_id").join(V.paper_rows(spark, sf_dir).select("paper_id", "title"), "paper_id", "left")
    rows = fusion.judged(texts, _hit_terms(spark, sf_dir)).withColumn("key", fusion.source_key())
    return fusion.round_robin(rows, _ranked(spark, sf_dir, 4, hits), 12).withColumn("pos", F.col("pos").cast("long"))


@query(over(f"SELECT chunk_id, ({_BACK}) AND NOT ({_DIRECT}) AS background FROM (SELECT chunk_id, lower(section_title || ' ' || CASE WHEN chunk_id % 5 = 0 THEN 'Existing methods: ' ELSE '' END || content) AS t FROM chunks)", "chunks"))
def e13_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.when(F.col("chunk_id") % 5 == 0, "Existing methods: ").otherwise(""), "content")
    return V.chunks(spark, sf_dir).select("chunk_id", fusion.background_only(F.col("section_title"), content).alias("background"))


@query(
    over(
        """SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(len(a.s), 0) AS papers_old, coalesce(len(b.s), 0) AS papers_new, a.n AS hits_old, b.n AS hits_new, round(a.v, 5) AS avg_old, round(b.v, 5) AS avg_new,
  len(list_filter(coalesce(b.s, []), lambda x: NOT list_contains(coalesce(a.s, []), x))) AS gained, len(list_filter(coalesce(a.s, []), lambda x: NOT list_contains(coalesce(b.s, []), x))) AS lost
  FROM (SELECT question_id, list(DISTINCT paper_id) AS s, count(*) AS n, avg(score) AS v FROM hits WHERE route = 'dense' GROUP BY ALL) a
  FULL JOIN (SELECT question_id, list(DISTINCT paper_id) AS s, count(*) AS n, avg(score) AS v FROM hits WHERE route = 'lexical' GROUP BY ALL) b ON a.question_id = b.question_id""",
        "hits",
    )
)
def e17_compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir)
    out = fusion.compare_runs(rows.where("route = 'dense'"), rows.where("route = 'lexical'"))
    return out.withColumns({"avg_old": F.round("avg_old", 5), "avg_new": F.round("avg_new", 5)})


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT doc_id, md5('CHUNK:' || doc_id) AS h FROM documents)")
def a15_derived_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", dense.derived_id("CHUNK", F.col("doc_id")).alias("uuid"))
