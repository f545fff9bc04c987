"""The registered queries of this folder: ``opN_<name>`` for operator N, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, chat_format, chat_repair, decontaminate, line_dedup, ngram_join, quality_rules, ranked_search, sharding, span_dedup, suffix_dedup, token_files, url_filter
from paperloom.llm.common import scratch_dir
from paperloom.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.quality_rules(docs, clean=False)
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


#: The listed rules of op2: fixed values.
URL_RULES = (
    url_filter.UrlRule("block", "net", "/"),
    url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"),
    url_filter.UrlRule("allow", "org", "/fr/"),
)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are the pages whose id has a quality label: 0 is the blocked class."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select(F.col("page_id").alias("id"), "url", (1 - F.col("quality")).alias("blocked"))
    model = url_filter.fit_url_model(labelled)
    return url_filter.filter_urls(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with the items that its tiles cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("_rid")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(turns))
    rows = rows.unionByName(extra).withColumn("parts", chat_format.text_part(F.col("text")))
    out = chat_format.loss_texts(chat_format.read_chats(chat_format.format_chats(rows)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode(docs, vocabulary, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_components(docs).drop("_rid")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_by_bytes(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses text: the smallest document that keeps some of it, the places cut and the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = span_dedup.dedup_spans(docs).where("removed_spans IS NOT NULL")
    cut = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "first_id", F.size("removed_spans").alias("n_spans"), cut.alias("removed_bytes"), "removed_spans", F.col("text").alias("clean_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that loses lines: the documents that keep them, how many go and the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs).where("removed_lines > 0")
    return out.select("doc_id", F.array_min("first_ids").alias("first_id"), "removed_lines", "emptied", F.col("text").alias("clean_text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{scratch_dir(spark)}/tokens"
    vocabulary = token_files.WordVocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    token_files.write_tokens(docs, vocabulary, path, end_id=1)
    return token_files.read_documents(spark, path)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = chat_repair.repair_report(chat_repair.repair_conversations(chat_repair.damaged(rows)))
    # Conversations that lost every row come back empty.
    whole = rows.select("conv_id").distinct().join(told.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv"), "left").drop("_conv")
    figures = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(table(spark, sf_dir, "benchmark").select("item_id", "text"), ranked_search.build_index(docs))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.dedup_bytes(docs)
    return out.select(
        "doc_id",
        F.coalesce("n_bytes", F.lit(0).cast("long")).alias("n_bytes"),
        F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_url_filters,
        op3_decontamination,
        op4_chat_format,
        op5_byte_bpe,
        op6_ngram_join,
        op7_sharding,
        op8_substring_dedup,
        op9_line_dedup,
        op10_token_files,
        op11_conversation_repair,
        op12_ranked_search,
        op13_suffix_dedup,
    )
}

__all__ = ["ORACLES", "QUERIES"]
