"""Facts from figures, tables, equations and algorithms, and the model output that describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import collapse, has_any, trim_all

TABLE_WORDS = ("parameter", "configuration", "setting", "hyperparameter")
LIST_FIELDS = ("components", "connections", "implementationFacts")
NO_ASSESSMENT = "Provider omitted uncertainty assessment; manual review required."


def _text(json: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{field}"), F.lit(""))


def mine_steps(assets: DataFrame) -> DataFrame:
    """asset_id, fact_key (step_n), fact_value: the numbered steps of algorithms."""
    mark = r"(?:^|\s)\((\d{1,2})\)"
    steps = _text(F.col("structured"), "rawSteps")
    numbers, texts = F.regexp_extract_all(steps, F.lit(mark), F.lit(1)), F.split(steps, mark)
    zipped = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), collapse(F.get(texts, i + 1)).alias("t")))
    rows = assets.where("asset_type = 'ALGORITHM'").select("asset_id", F.explode(zipped).alias("s"))
    return rows.select("asset_id", F.concat(F.lit("step_"), "s.n").alias("fact_key"), F.col("s.t").alias("fact_value"))


def mine_equations(assets: DataFrame) -> DataFrame:
    """asset_id, fact_type, fact_value: equations; a loss where the text nearby speaks of one."""
    rows = assets.where("asset_type = 'EQUATION'").withColumns({"e": _text(F.col("structured"), "expression"), "near": F.lower(_text(F.col("structured"), "nearbyText"))})
    return rows.where(trim_all(F.col("e")) != "").select("asset_id", F.when(has_any(F.col("near"), ("loss", "objective")), "LOSS").otherwise("EQUATION").alias("fact_type"), F.col("e").alias("fact_value"))


def mine_tables(assets: DataFrame) -> DataFrame:
    """asset_id, fact_value: tables whose text or caption speaks of parameters."""
    parts = [F.get_json_object("structured", "$.markdown"), F.get_json_object("structured", "$.rawRows"), F.col("raw_text")]
    source = F.coalesce(*[F.when(trim_all(x) != "", x) for x in parts])
    rows = assets.where("asset_type = 'TABLE'").withColumn("source", source).where("source IS NOT NULL")
    words = F.lower(F.concat_ws(" ", "source", F.coalesce("caption", F.lit(""))))
    return rows.where(has_any(words, TABLE_WORDS)).select("asset_id", F.col("source").alias("fact_value"))


def as_list(json: Column, field: str) -> Column:
    """A JSON field as array<string>: one value becomes a list of one, none an empty list."""
    raw = F.get_json_object(json, f"$.{field}")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))


def normalize_vision_json(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """purpose, lists of components, connections, facts and doubts of a model's JSON, and a problem where it is refused."""
    bare = F.regexp_replace(F.regexp_replace(trim_all(F.coalesce(F.col(raw), F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    out = rows.withColumn("_j", bare)
    purpose = F.get_json_object("_j", "$.purpose")
    problem = F.when(F.col("_j") == "", "empty").when(F.get_json_object("_j", "$").isNull() | ~F.col("_j").startswith("{"), "no object").when(purpose.isNull(), "no purpose")
    doubts = as_list(F.col("_j"), "uncertainClaims")
    told = {"purpose": purpose, **{f: as_list(F.col("_j"), f) for f in LIST_FIELDS}, "uncertainClaims": F.when(F.get_json_object("_j", "$.uncertainClaims").isNull(), F.array(F.lit(NO_ASSESSMENT))).otherwise(doubts)}
    return out.withColumns({**told, "problem": problem}).drop("_j")


SEMANTIC_TYPES = (("components", "ARCHITECTURE_COMPONENT", "component"), ("connections", "ARCHITECTURE_CONNECTION", "connection"), ("implementationFacts", "IMPLEMENTATION", "implementation"))


def mine_semantics(assets: DataFrame) -> DataFrame:
    """asset_id, fact_type, fact_key, fact_value, confidence: purpose, components, connections and implementation facts.

    List items are numbered from 1, blank ones left out; doubts are no facts. Confidence follows the review status.
    """
    rows = normalize_vision_json(assets, "semantic").where("problem IS NULL")
    one = F.array(F.struct(F.lit("ARCHITECTURE").alias("t"), F.lit("purpose").alias("k"), F.col("purpose").alias("v")))

    def numbered(field: str, kind: str, key: str) -> Column:
        full = F.filter(F.col(field), lambda x: trim_all(x) != "")
        return F.transform(full, lambda x, i: F.struct(F.lit(kind).alias("t"), F.concat(F.lit(key + "_"), i + 1).alias("k"), x.alias("v")))

    facts = F.concat(F.filter(one, lambda x: trim_all(x["v"]) != ""), *[numbered(*x) for x in SEMANTIC_TYPES])
    sure = F.when(F.col("verification_status") == "USER_CONFIRMED", 1.0).when(F.col("verification_status") == "CROSS_CHECKED", 0.95).otherwise(F.least(F.lit(0.6), F.coalesce("confidence", F.lit(0.0))))
    return rows.select("asset_id", F.explode(facts).alias("f"), sure.alias("confidence")).select("asset_id", F.col("f.t").alias("fact_type"), F.col("f.k").alias("fact_key"), F.col("f.v").alias("fact_value"), "confidence")


def mine_context(assets: DataFrame) -> DataFrame:
    """asset_id, fact_key, fact_value: what stands around figures, tables and algorithms, keyed by label and page."""
    label = F.coalesce(F.when(trim_all(F.col("label")) != "", F.col("label")), F.lower("asset_type"))
    rows = assets.where(F.col("asset_type").isin("FIGURE", "TABLE", "ALGORITHM") & (F.coalesce(trim_all(F.col("raw_text")), F.lit("")) != ""))
    return rows.select("asset_id", F.concat(label, F.lit("@p"), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("/context")).alias("fact_key"), collapse(F.col("raw_text")).alias("fact_value"))
