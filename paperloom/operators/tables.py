"""Keeping tables: rebuilds, upserts, cascades, categories, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import trim_all


def scan_papers(papers: DataFrame, categories: DataFrame, category: int | None = None) -> DataFrame:
    """Papers, of one category if given, newest first, with the category's name."""
    rows = papers.where(F.col("category_id") == category) if category is not None else papers
    return rows.join(categories.select("category_id", "name"), "category_id", "left").orderBy(F.desc_nulls_last("publish_year"), F.desc("paper_id"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key in ``new`` take the place of those in ``old``; keys that ``new`` lacks stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def rebuild_partitions(new: DataFrame, path: str, by: str) -> None:
    """Write ``new`` over the partitions of ``by`` that it has rows of, in a stored table; other partitions keep their files."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of those in ``old`` with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def upsert_versioned(old: DataFrame, new: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """One row for each key: new values win, an existing row keeps its id."""
    values = [c for c in new.columns if c not in (*keys, row_id)]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    fresh = F.coalesce(*[F.col(f"n.{c}").isNotNull() for c in (values[:1] or [row_id])], F.lit(False))
    return both.select(*keys, F.coalesce(f"o.{row_id}", f"n.{row_id}").alias(row_id), *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values])


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """Every table without the rows of ``ids``."""
    gone = ids.select(key).distinct()
    return {name: t.join(gone, key, "left_anti").select(*t.columns) for name, t in tables.items()}


def repair_category(papers: DataFrame, categories: DataFrame, default: int) -> DataFrame:
    """Null or dangling categories become the default."""
    known = categories.select("category_id", F.lit(True).alias("_known"))
    rows = papers.join(known, "category_id", "left")
    return rows.withColumn("category_id", F.when(F.col("_known"), F.col("category_id")).otherwise(F.lit(default).cast("long"))).select(*papers.columns)


def ensure_default(categories: DataFrame, default: DataFrame, key: str = "name") -> DataFrame:
    """Adds the rows of ``default`` whose key is absent."""
    return categories.unionByName(default.join(categories.select(key), key, "left_anti").select(*categories.columns))


def retire_categories(papers: DataFrame, categories: DataFrame, ids: DataFrame, default: int) -> tuple[DataFrame, DataFrame]:
    """(papers, categories): members move to the default; system categories are refused and stay."""
    gone = categories.join(ids.select("category_id").distinct(), "category_id", "left_semi").where(~F.col("system_flag")).select("category_id", F.lit(True).alias("_gone"))
    moved = papers.join(gone, "category_id", "left").withColumn("category_id", F.when(F.col("_gone"), F.lit(default).cast("long")).otherwise(F.col("category_id"))).select(*papers.columns)
    return moved, categories.join(gone, "category_id", "left_anti").select(*categories.columns)


def category_counts(categories: DataFrame, papers: DataFrame) -> DataFrame:
    """Categories with their number of papers, zero too, in their order."""
    n = papers.groupBy("category_id").agg(F.count("*").alias("papers"))
    return categories.join(n, "category_id", "left").na.fill(0, ["papers"]).orderBy("sort_order", "category_id")


def allocate_sort_order(new: DataFrame, categories: DataFrame, order: str = "name") -> DataFrame:
    """New rows numbered in tens after the largest sort order, from 10 in an empty table. New rows are few."""
    last = categories.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("_last"))
    return new.crossJoin(F.broadcast(last)).withColumn("sort_order", F.col("_last") + 10 * F.row_number().over(Window.orderBy(order))).drop("_last")


def metadata_problem(title: Column, year: Column, journal: Column | None = None) -> Column:
    """Why a row's metadata is refused, or null."""
    t = trim_all(F.coalesce(title, F.lit("")))
    out = F.when(t == "", "title missing").when(F.length(t) > 500, "title too long").when(year.isNotNull() & ~year.between(1000, 2100), "year out of range")
    return out if journal is None else out.when(F.length(trim_all(journal)) > 500, "journal too long")


def normalize_ids(ids: Column) -> Column:
    """Positive ids, each once, in first order."""
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x > 0)))


def parse_ids(text: Column) -> Column:
    """Ids of a comma-separated text; what is no number is skipped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: trim_all(x).try_cast("long")), lambda x: x.isNotNull())


def backfill_chunks(chunks: DataFrame) -> DataFrame:
    """Nulls of derived chunk columns replaced: type UNKNOWN, index text the content, tokens a quarter of its length."""
    content = F.coalesce("content", F.lit(""))
    return chunks.withColumns(
        {
            "section_type": F.coalesce("section_type", F.lit("UNKNOWN")),
            "index_text": F.coalesce("index_text", "content"),
            "token_count": F.coalesce("token_count", F.ceil(F.length(content) / 4).cast("long")),
            "char_count": F.coalesce("char_count", F.length(content).cast("long")),
        }
    )


def check_unique_names(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """key, problem of new names: blank, twice in the batch, or taken; compared without case."""
    name = F.lower(trim_all(F.coalesce("name", F.lit(""))))
    rows = new.select(key, name.alias("n"))
    taken = existing.select(F.lower(trim_all(F.col("name"))).alias("n")).distinct().withColumn("taken", F.lit(True))
    rows = rows.join(taken, "n", "left").withColumn("twice", F.count("*").over(Window.partitionBy("n")) > 1)
    return rows.select(key, F.when(F.col("n") == "", "blank").when(F.col("taken"), "taken").when(F.col("twice"), "twice").alias("problem")).where("problem IS NOT NULL")


def index_status(points: DataFrame, papers: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """paper_id, one count of indexed points for each kind, complete: every kind is there."""
    counts = points.groupBy("paper_id").pivot("content_type", list(kinds)).agg(F.count(F.lit(1)))
    rows = papers.select("paper_id").join(counts, "paper_id", "left").na.fill(0, list(kinds))
    done = F.lit(True)
    for k in kinds:
        done = done & (F.col(k) > 0)
    return rows.withColumn("complete", done)


def manifest(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, sha256 and size in bytes of every file."""
    return files.select(F.col(path).alias("path"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def export_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines, in order through the files by name: parts by ranges of ``order``, sorted inside."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def export_texts(files: DataFrame, path: str, kind: str, text: str, rows_a_file: int = 100_000) -> None:
    """The texts as text files below a folder for each ``kind``."""
    files.select(kind, text).write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(kind).text(path)


def exported_manifest(files: DataFrame, kind: str) -> DataFrame:
    """kind, path, bytes, lines, digest of every file that lies in an exported folder, from the files themselves.

    The digest is that of the file's bytes; ``files`` is the folder read as binary files.
    """
    lines = F.octet_length("content") - F.octet_length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return files.select(kind, "path", F.col("length").alias("bytes"), lines.cast("long").alias("lines"), F.sha2("content", 256).alias("digest"))
