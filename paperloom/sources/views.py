"""Views that give the test tables the shape of the operators' inputs; each is one expression over its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators.lexical import contained_terms

UNIT_TYPES = (
    "RESEARCH_DOMAIN", "RESEARCH_TASK", "RESEARCH_PROBLEM", "KEYWORD", "METHOD", "MODEL_COMPONENT", "DATASET", "INPUT_VARIABLE", "METRIC",
    "EXPERIMENT_SETTING", "RESULT", "COMPARISON", "CONTRIBUTION", "LIMITATION", "FUTURE_WORK", "CONCLUSION", "BACKGROUND",
)


#: A table of fewer bytes may be one row group, which one task would read and work on alone.
SMALL_TABLE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; rows of a small one are dealt to all cores, a larger one is parted by its own files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if int(size) < SMALL_TABLE else df


def pick(values, index):
    """values[index] for a column ``index`` from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _paper(doc_id):
    return F.floor(doc_id / 6) + 1


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six consecutive documents make a paper: paper_id, title, text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumns({"paper_id": _paper(F.col("doc_id")), "k": F.col("doc_id") % 6})
    size = 16 * (F.col("paper_id") % 2 + 1)
    setup = F.concat(F.lit("We use a learning rate of 0.00"), F.col("paper_id") % 3 + 1, F.lit(" and batch size "), size, F.lit(". We propose an archi-\ntecture."))
    trial = F.concat(F.lit("Evaluation on dataset D"), F.col("paper_id") % 5, F.lit(" with batch size 32 for 50 epochs."))
    line = F.when(F.col("k") == 0, "12").when(F.col("k") == 1, "doi: 10.1000/x").when(F.col("k") == 2, setup).when(F.col("k") == 3, trial).otherwise("")
    part = F.concat(pick(rules.SECTION_HEADINGS, F.col("k")), F.lit("\n"), line, F.lit("\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    parts = d.select("paper_id", F.struct("doc_id", part.alias("part")).alias("p")).groupBy("paper_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return parts.select("paper_id", F.concat(F.lit("Paper "), "paper_id").alias("title"), F.array_join("ps.part", "\n\n").alias("text"))


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the papers: paper_id, category_id (0 is dangling), title, publish_year, keywords."""
    d = table(spark, sf_dir, "documents").select("doc_id").where("doc_id % 6 = 0").select(_paper(F.col("doc_id")).alias("paper_id"))
    p = F.col("paper_id")
    return d.select(
        "paper_id",
        (p % 9).alias("category_id"),
        F.concat(F.lit("Paper "), p, F.when(p % 7 == 0, " a survey").otherwise("")).alias("title"),
        F.when(p % 11 == 0, None).otherwise(900 + p * 37 % 1300).alias("publish_year"),
        F.concat(F.lit("kw"), p % 4, F.lit(", topic"), p % 3).alias("keywords"),
        F.when(p % 4 == 0, "FAILED").otherwise("COMPLETED").alias("parse_status"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources as categories; ids count by name from 1, those divisible by 7 are left out."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    ids = names.withColumn("category_id", F.row_number().over(Window.orderBy("name")).cast("long"))
    return ids.where("category_id % 7 <> 0").select("category_id", "name", (F.col("category_id") * 10).alias("sort_order"), (F.col("category_id") == 1).alias("system_flag"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of papers, one for each section."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p, k = _paper(F.col("doc_id")), F.col("doc_id") % 6
    setup = F.concat(F.lit("We use a learning rate of 0.00"), p % 3 + 1, F.lit(" and batch size "), 16 * (p % 2 + 1), F.lit(". We propose an architecture. "), "text")
    trial = F.concat(F.lit("Evaluation on dataset D"), p % 5, F.lit(" with batch size 32 for 50 epochs. "), "text")
    content = F.when(k == 2, setup).when(k == 3, trial).otherwise(F.col("text"))
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        p.alias("paper_id"),
        k.alias("chunk_index"),
        pick(rules.SECTION_TYPES, k).alias("section_type"),
        pick(rules.SECTION_HEADINGS, k).alias("section_title"),
        content.alias("content"),
        (k == 5).alias("is_reference"),
        (F.length("text") < 200).alias("is_noise"),
        F.round(F.length("text") % 100 / 100.0, 2).alias("quality_score"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, chunk_id): the document holds the whole text of the item, found by the item's rarest gram."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return contained_terms(docs, items.select("term"), "chunk_id", "text").join(items, "term").select("question_id", "chunk_id")


VECTOR_TYPES = ("paper_profile", "section_summary", "raw_chunk")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 50 + 1).alias("paper_id"), pick(VECTOR_TYPES, F.col("label") % 3).alias("content_type"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str, at: int = 0) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100; ``at`` 50 stands for rewritten questions."""
    v = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == at)
    return v.select(F.floor(F.col("vec_id") / 100).alias("query_id"), F.col("embedding").alias("query"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge units made of documents and their labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels")
    j = d.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "GOLD").when(F.col("quality").isNotNull(), "SILVER").otherwise("BRONZE")
    return j.select(
        i.alias("unit_id"),
        _paper(i).alias("paper_id"),
        pick(UNIT_TYPES, i % 17).alias("knowledge_type"),
        F.concat(F.lit("Subject "), i % 5).alias("subject_text"),
        F.lit("states").alias("predicate_text"),
        F.when(i % 3 == 0, F.concat_ws(" ", "source", "lang")).otherwise(F.col("text")).alias("object_value"),
        tier.alias("confidence_level"),
        pick(("LLM", "USER", "PROFILE", "DETERMINISTIC", "SECTION_SUMMARY"), i % 5).alias("extraction_method"),
        F.when(i % 19 == 0, "REJECTED").when(i % 4 == 0, "CONFIRMED").otherwise("AUTO").alias("verification_status"),
        F.when(i % 8 != 0, F.col("text")).alias("evidence_text"),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_id"), "role", F.col("text").alias("content"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_type").alias("stage"), F.col("value").alias("ms"), "ts", "event_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    done = F.floor(F.col("value")) % 20
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("paper_id"), status.alias("status"), F.col("ts").alias("create_time"), done.alias("processed"), F.lit(20).cast("long").alias("total")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "CONFIRM").when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "signup", "CORRECT")
    e = table(spark, sf_dir, "events").withColumn("action", action).where("action IS NOT NULL")
    value = F.when(F.col("action") == "CORRECT", F.concat(F.lit("v"), "event_id"))
    return e.select("event_id", F.col("user_id").alias("unit_id"), "action", value.alias("object_value"), "ts")
