"""Registered queries over assets and model output (B21, J2-J6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import assets as A
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import trimmed
from paperloom.sources import views as V

_TYPES = ("EQUATION", "ALGORITHM", "TABLE", "FIGURE")


#: A text as one line of words, which JSON takes as it is.
_CLEAN = r"[^\p{L}\p{N}]+"
_WORDS = f"trim(regexp_replace(text, '{_CLEAN}', ' ', 'g'))"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset made of each document: its type by id, its text as raw text and inside the JSON that parsers and models give."""
    i, words = F.col("doc_id"), F.trim(F.regexp_replace("text", _CLEAN, " "))
    steps = F.concat(F.lit("(1) load "), words, F.lit(" (2) train  on "), "lang", F.lit(" (3) stop"))
    near = F.concat(F.when(i % 3 == 0, "The loss of ").otherwise("We define "), "lang")
    structured = F.to_json(F.struct(F.concat(F.lit("y = "), words).alias("expression"), near.alias("nearbyText"), steps.alias("rawSteps"), F.when(i % 8 == 2, F.lit("| a |")).alias("markdown")))
    semantic = F.when(i % 5 == 0, F.concat(F.lit("not json "), words)).when(
        i % 5 == 1, F.concat(F.lit('```json\n{"purpose": "shows '), words, F.lit('", "components": "one", "uncertainClaims": []}\n```'))
    ).otherwise(F.concat(F.lit('{"purpose": "p", "components": ["a", " ", "'), words, F.lit('"], "connections": [], "implementationFacts": ["x"]}')))
    return V.table(spark, sf_dir, "documents").select(
        i.alias("asset_id"), V.pick(_TYPES, i % 4).alias("asset_type"), F.concat(F.lit("Label "), i % 6).alias("label"), (i % 9).alias("page"), F.when(i % 3 == 1, "Parameter settings").otherwise("Plain").alias("caption"),
        F.col("text").alias("raw_text"), structured.alias("structured"), semantic.alias("semantic"), F.when(i % 2 == 0, "USER_CONFIRMED").otherwise("EXTRACTED").alias("verification_status"), (i % 10 / 10.0).alias("confidence"),
    )


@query(f"SELECT doc_id AS asset_id, CASE WHEN doc_id % 5 = 0 THEN 'no object' ELSE 'ok' END AS problem, md5(CASE WHEN doc_id % 5 = 1 THEN 'shows ' || {_WORDS} WHEN doc_id % 5 > 1 THEN 'p' ELSE '' END) AS purpose, md5(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'one' ELSE 'a, ,' || {_WORDS} END) AS components, CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 1 END AS doubts FROM documents")
def b21_normalize_vision_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.normalize_vision_json(_assets(spark, sf_dir), "semantic")
    return out.select("asset_id", F.coalesce("problem", F.lit("ok")).alias("problem"), F.md5(F.coalesce("purpose", F.lit(""))).alias("purpose"), F.md5(F.array_join("components", ",")).alias("components"), F.size("uncertainClaims").cast("long").alias("doubts"))


@query(f"SELECT doc_id AS asset_id, 'step_' || n AS fact_key, md5(CASE n WHEN 1 THEN 'load ' || {_WORDS} WHEN 2 THEN 'train on ' || lang ELSE 'stop' END) AS digest FROM documents CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE doc_id % 4 = 1")
def j2_mine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mine_steps(_assets(spark, sf_dir)).select("asset_id", "fact_key", F.md5("fact_value").alias("digest"))


@query(f"SELECT doc_id AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 'LOSS' ELSE 'EQUATION' END AS fact_type, md5('y = ' || {_WORDS}) AS digest FROM documents WHERE doc_id % 4 = 0")
def j3_mine_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mine_equations(_assets(spark, sf_dir)).select("asset_id", "fact_type", F.md5("fact_value").alias("digest"))


@query("SELECT doc_id AS asset_id, md5(CASE WHEN doc_id % 8 = 2 THEN '| a |' ELSE text END) AS digest FROM documents WHERE doc_id % 4 = 2 AND (doc_id % 3 = 1 OR (doc_id % 8 <> 2 AND (contains(lower(text), 'parameter') OR contains(lower(text), 'configuration') OR contains(lower(text), 'setting'))))")
def j4_mine_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mine_tables(_assets(spark, sf_dir)).select("asset_id", F.md5("fact_value").alias("digest"))


@query(
    f"""SELECT asset_id, fact_type, fact_key, md5(fact_value) AS digest, confidence FROM (SELECT doc_id AS asset_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE least(0.6, doc_id % 10 / 10.0) END AS confidence, unnest(CASE WHEN doc_id % 5 = 1
  THEN [{{'fact_type': 'ARCHITECTURE', 'fact_key': 'purpose', 'fact_value': 'shows ' || {_WORDS}}}, {{'fact_type': 'ARCHITECTURE_COMPONENT', 'fact_key': 'component_1', 'fact_value': 'one'}}]
  ELSE list_filter([{{'fact_type': 'ARCHITECTURE', 'fact_key': 'purpose', 'fact_value': 'p'}}, {{'fact_type': 'ARCHITECTURE_COMPONENT', 'fact_key': 'component_1', 'fact_value': 'a'}},
    {{'fact_type': 'ARCHITECTURE_COMPONENT', 'fact_key': 'component_2', 'fact_value': {_WORDS}}}, {{'fact_type': 'IMPLEMENTATION', 'fact_key': 'implementation_1', 'fact_value': 'x'}}], lambda f: f.fact_value <> '') END, recursive := true) FROM documents WHERE doc_id % 5 > 0)"""
)
def j5_mine_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mine_semantics(_assets(spark, sf_dir)).select("asset_id", "fact_type", "fact_key", F.md5("fact_value").alias("digest"), "confidence")


@query(f"""SELECT doc_id AS asset_id, 'Label ' || (doc_id % 6) || '@p' || (doc_id % 9) || '/context' AS fact_key, md5({trimmed("regexp_replace(text, '\\s+', ' ', 'g')")}) AS digest FROM documents WHERE doc_id % 4 > 0""")
def j6_mine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mine_context(_assets(spark, sf_dir)).select("asset_id", "fact_key", F.md5("fact_value").alias("digest"))
