"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes every stage as Parquet in the shared scratch folder and reads it again for the next.

Very long texts pass all stages whole, each bounded by its own row. Ties: of equal ids the row key decides which line or
document stays first; repeated rows are treated alike until the third stage keeps one of them. An empty table gives no
rows; nulls are told at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from paperloom.llm.common import Scratch, key_join, packed, unpacked


def _with_text(rows: DataFrame, columns: list[str], docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the text beside them and, where the table has it, its length."""
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {}
    return unpacked(rows, columns, text=F.col("text"), **length)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail a line rule. Null and empty texts are rejected."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    judged = quality_rules.quality_rules(rows, into="quality").where("quality.kept")
    return _with_text(judged.select("row", F.col("quality.clean_text").alias("text")), docs.columns, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Repeated stretches of two or more lines go; so does a document of which nothing is left.

    Null and empty texts stay as they are.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    out = line_dedup.dedup_lines(rows, scratch=scratch).where(~F.col("emptied"))
    return _with_text(out.select("row", "text"), docs.columns, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays, once.

    Documents without a word are in no group and stay; rows with a null id stay too, unless a row with an id is in
    their group.
    """
    scratch = scratch or Scratch(spark)
    found = ngram_join.ngram_components(docs, scratch=scratch)
    gone = found.where("n_shingles > 0 AND component_id IS NOT NULL AND NOT doc_id <=> component_id").select(F.col("_rid").alias("rid")).distinct()
    gone = scratch.write(gone, "gone")
    rest = key_join(packed(docs, "doc_id", "text"), gone, "rid", "left_anti")
    # Repeated rows of the document that stays: one of them.
    again = scratch.write(rest.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").groupBy("rid").count().where("count > 1").select("rid"), "again")
    once = key_join(rest, again, "rid", "left_semi").groupBy("rid").agg(F.first("row").alias("row")).select("row")
    return unpacked(key_join(rest, again, "rid", "left_anti").select("row").unionByName(once), docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that a benchmark item's tiles cover go; without items, and without text, all stay."""
    scratch = scratch or Scratch(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = scratch.write(decontaminate.contaminated(docs, items, scratch=scratch).select(F.col("_rid").alias("rid")).distinct(), "gone")
    return unpacked(key_join(packed(docs, "doc_id", "text"), gone, "rid", "left_anti"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of every document, how many they are, and the digest of the bytes that they decode to.

    Null and empty texts have no ids; repeated rows stay; other columns are not handed on.
    """
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode(docs, vocabulary, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("byte-level BPE", tokens),
]

#: The stages judge lines by code, cut content-defined chunks and apply BPE merges, which SQL cannot state.
ORACLE_SQL = None


#: Stages that leave tables in a scratch folder, which ``run`` drops when their result is written.
_WITH_SCRATCH = {lines, near_duplicates, benchmark_free}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Extra columns pass through all but the last; an empty table gives no rows."""
    results = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        own = Scratch(spark)
        docs = results.write(stage(spark, docs, sf_dir, **({"scratch": own} if stage in _WITH_SCRATCH else {})), f"stage_{i}")
        own.drop()
    return docs
