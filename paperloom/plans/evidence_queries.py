"""Registered queries over strategies and evidence (F, J15, J18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import evidence as E
from paperloom.operators import knowledge as K
from paperloom.plans import knowledge_queries, search_queries, text_queries
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, over
from paperloom.sources import views as V

_TOKENS = "greatest(1, CAST(ceil(length(content) / 4.0) AS BIGINT))"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for no, one or two papers, as many as there are papers."""
    p = V.paper_rows(spark, sf_dir).select("paper_id")
    i = F.col("paper_id")
    none = F.array().cast("array<bigint>")
    return p.select(i.alias("question_id"), F.when(i % 3 == 0, none).when(i % 3 == 1, F.array(i)).otherwise(F.array(i, i - 1)).alias("paper_ids"))


@query(
    over(
        f"""SELECT question_id, CASE WHEN n = 0 THEN 'DISCOVERY' WHEN n > 1 THEN CASE WHEN profiled THEN 'HYBRID' ELSE 'VECTOR' END WHEN parsed AND tokens BETWEEN 1 AND 3000 THEN 'FULL_TEXT' ELSE 'VECTOR' END AS strategy FROM (
  SELECT r.question_id, count(r.paper_id) AS n, bool_and(coalesce(r.paper_id % 5 <> 0, false)) AS profiled, bool_and(coalesce(p.parse_status = 'COMPLETED', false)) AS parsed, coalesce(sum(t.tokens), 0) AS tokens FROM (
    SELECT paper_id AS question_id, CAST(NULL AS BIGINT) AS paper_id FROM paper_rows WHERE paper_id % 3 = 0 UNION ALL SELECT paper_id, paper_id FROM paper_rows WHERE paper_id % 3 > 0 UNION ALL SELECT paper_id, paper_id - 1 FROM paper_rows WHERE paper_id % 3 = 2) r
  LEFT JOIN paper_rows p USING (paper_id) LEFT JOIN (SELECT paper_id, sum({_TOKENS}) AS tokens FROM usable GROUP BY 1) t USING (paper_id) GROUP BY 1)""",
        "paper_rows",
        "usable",
    )
)
def f5_choose_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.paper_rows(spark, sf_dir)
    return E.choose_strategy(_requests(spark, sf_dir), papers, V.chunks(spark, sf_dir), papers.where("paper_id % 5 <> 0"), 3000)


_FRESH = "s.section <> x.section"
_CLOSED = f"(NOT ({_FRESH}) AND s.closed)"
_FITS = "s.used + x.used <= 1500"
_TAKE = f"({_FITS} AND NOT {_CLOSED} AND NOT s.ended)"


@query(
    over(
        f"""SELECT paper_id, array_to_string(f.out[1:20], ',') AS chunk_ids, f.used AS tokens FROM (SELECT paper_id, list_reduce(list_prepend({{'out': CAST([] AS BIGINT[]), 'used': CAST(0 AS BIGINT), 'section': '', 'closed': false, 'ended': false}},
  list({{'out': [chunk_id], 'used': {_TOKENS}, 'section': section_type, 'closed': false, 'ended': false}} ORDER BY chunk_index)), lambda s, x: {{'out': CASE WHEN {_TAKE} THEN list_concat(s.out, x.out) ELSE s.out END, 'used': CASE WHEN {_TAKE} THEN s.used + x.used ELSE s.used END,
    'section': x.section, 'closed': {_CLOSED} OR NOT ({_FITS}), 'ended': s.ended OR ({_FRESH} AND NOT ({_FITS}))}}) AS f FROM usable GROUP BY paper_id)""",
        "usable",
    )
)
def f6_fulltext_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.fulltext_context(V.chunks(spark, sf_dir), 1500)
    return out.select("paper_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"), "tokens")


def _ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.c6_bm25_topk(spark, sf_dir).join(V.chunks(spark, sf_dir), "chunk_id")


@query(
    over(
        f"""SELECT question_id, no, chunk_id FROM (SELECT *, row_number() OVER w AS no, sum(n) OVER w AS upto FROM (SELECT question_id, chunk_id, rank, length(substr({text_queries.trimmed("regexp_replace(content, '\\s+', ' ', 'g')")}, 1, 1200)) AS n
  FROM topped JOIN chunks USING (chunk_id) WHERE {text_queries.LOW_VALUE}) WINDOW w AS (PARTITION BY question_id ORDER BY rank, chunk_id)) WHERE upto <= 4000""",
        "topped",
        "chunks",
    )
)
def f9_pack_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pack_sources(_ranked_chunks(spark, sf_dir)).select("question_id", F.col("no").cast("long").alias("no"), "chunk_id")


@query(over("SELECT paper_id, chunk_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE section_type WHEN 'METHOD' THEN 1 WHEN 'EXPERIMENT' THEN 2 ELSE 3 END, chunk_id) AS pos FROM chunks) WHERE pos <= 4", "chunks"))
def f7_f15_section_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.section_sources(V.chunks(spark, sf_dir), ("METHOD", "EXPERIMENT"), 4)
    return out.select("paper_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query(
    over(
        f"SELECT p.paper_id, f.family FROM paper_rows p CROSS JOIN (SELECT unnest(['METHOD', 'DATASET', 'RESULT']) AS family) f WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.paper_id = p.paper_id AND ({knowledge_queries._FAMILY}) = f.family AND confidence_level IN ('GOLD', 'SILVER'))",
        "paper_rows",
        "units",
    )
)
def f13_missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = V.units(spark, sf_dir).select("paper_id", K.family(F.col("knowledge_type")).alias("family"), (K.tier_rank(F.col("confidence_level")) >= 2).alias("sure"))
    wanted = spark.createDataFrame([("METHOD",), ("DATASET",), ("RESULT",)], "family string")
    return E.missing_types(V.paper_rows(spark, sf_dir), wanted, units)


add_view("near", ("vectors", "vector_queries"), f"SELECT query_id AS question_id, point_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY {search_queries._COS} DESC, point_id) AS rank FROM vectors CROSS JOIN vector_queries")


@query(
    over(
        """SELECT question_id, key, pos FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY origin, rank, key) AS pos FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY origin, rank) AS n FROM (
  SELECT question_id, chunk_id AS key, rank, 0 AS origin FROM topped UNION ALL SELECT question_id, key, rank, 1 FROM near WHERE rank <= 10)) WHERE n = 1)) WHERE pos <= 12""",
        "topped",
        "near",
    )
)
def f17_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators import dense

    first = search_queries.c6_bm25_topk(spark, sf_dir).select("question_id", F.col("chunk_id").alias("key"), "rank")
    near = dense.cosine_topk(V.vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 10).select(F.col("query_id").alias("question_id"), F.col("point_id").alias("key"), F.col("rank").cast("long").alias("rank"))
    return E.merge_evidence(first, near, 12).withColumn("pos", F.col("pos").cast("long"))


@query(over(f"SELECT question_id, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM topped JOIN chunks USING (chunk_id) GROUP BY 1", "topped", "chunks"))
def f18_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.context_tokens(_ranked_chunks(spark, sf_dir))


_POINTS = " + ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN {points} ELSE 0 END" for points, words in E.CHUNK_POINTS)


@query(over(f"SELECT paper_id, chunk_id, points FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY points DESC, chunk_index) AS pos FROM (SELECT *, {_POINTS} AS points FROM (SELECT *, lower(section_title || ' ' || content) AS t FROM usable))) WHERE pos <= 3", "usable"))
def j15_top_chunk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_chunk_evidence(V.chunks(spark, sf_dir), 3).select("paper_id", "chunk_id", F.col("points").cast("long").alias("points"))
