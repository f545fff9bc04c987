"""Vectors: deterministic embeddings, quality gates, exact and approximate cosine search for a stated query set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.blocks import block_topk, cosines, looked_up
from paperloom.operators.lexical import topk
from paperloom.sources.scratch import written


def hash_embed(text: Column) -> Column:
    """Four numbers from a text's length and its 31-based 32-bit hash (over UTF-16 units)."""
    text = F.coalesce(text, F.lit(""))
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    units = F.transform(units, lambda c: F.conv(c, 16, 10).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.abs(F.aggregate(units, F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + c)))
    n = F.length(text).cast("long")
    return F.array(F.least(F.lit(1.0), n / 1000), (h % 100) / 100, (n * 3 % 100) / 100, (h % 97 + 1) / 100)


def validate_vectors(texts: DataFrame, vectors: DataFrame, dim: int, key: str) -> DataFrame:
    """key, problem: texts without a vector, vectors without a text, null texts, wrong dimensions."""
    both = texts.select(key, "text", F.lit(True).alias("t")).join(vectors.select(key, "embedding", F.lit(True).alias("v")), key, "full")
    problem = (
        F.when(F.col("t").isNull(), "no text")
        .when(F.col("text").isNull(), "null text")
        .when(F.col("v").isNull() | F.col("embedding").isNull(), "no vector")
        .when(F.size("embedding") != dim, "dimension")
    )
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; 0 where one has no length."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norm > 0, product(a, b) / norm).otherwise(0.0)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, by_type: bool = False) -> DataFrame:
    """query_id, point_id, paper_id, content_type, score, rank: exact search of every vector for a stated set of queries.

    All pairs are scored, block by block (``block_topk``). Filter ``vectors`` before the call to search part of them.
    """
    parts = ("query_id", "content_type") if by_type else ("query_id",)
    rows = vectors.select("point_id", "paper_id", "content_type", "embedding")
    best = block_topk(queries.select("query_id", "query"), rows, k, cosines, by="content_type" if by_type else None, keep=("paper_id", "content_type"))
    return topk(best, k, parts, "point_id")


def _unit(df: DataFrame, key: str, col: str) -> DataFrame:
    """key and the vector scaled to length one; vectors without a length are left out."""
    x = F.transform(col, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return df.select(key, x.alias("_x"), norm.alias("_norm")).where("_norm > 0").select(key, F.transform("_x", lambda v: v / F.col("_norm")).alias("unit"))


def lsh_topk(queries: DataFrame, vectors: DataFrame, k: int, bucket: float = 0.25, tables: int = 6, seed: int = 7) -> DataFrame:
    """Approximate search: candidates that share a bucket of random projections of unit vectors, ranked exactly.

    It prunes where near neighbours are near (cosines of 0.9 and more); vectors that all stand apart share buckets with
    most others, and ``ivf_topk`` fits them better.
    """
    as_rows = lambda df, key, col: _unit(df, key, col).select(key, array_to_vector("unit").alias("v"))
    index = as_rows(vectors, "point_id", "embedding")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(index)

    def hashed(rows: DataFrame, key: str) -> DataFrame:
        """key, table, bucket, a row for each table."""
        return model.transform(rows).select(key, F.posexplode("h").alias("table", "_h")).select(key, "table", vector_to_array("_h")[0].alias("bucket"))

    left = queries.select("query_id", "query").join(hashed(as_rows(queries, "query_id", "query"), "query_id"), "query_id")
    right = vectors.select("point_id", "embedding").join(hashed(index, "point_id"), "point_id")
    best = block_topk(left, right, k, cosines, on=("table", "bucket"))
    return topk(best.groupBy("query_id", "point_id").agg(F.max("score").alias("score")), k, ("query_id",), "point_id")


#: Tasks that a fitted sample is dealt to.
FIT_PARTS = 16


def fit_lists(vectors: DataFrame, lists: int = 64, sample: int = 20_000, seed: int = 7) -> KMeansModel:
    """Centres of an inverted file, fitted on at most ``sample`` vectors, those with the smallest hashes of their id.

    The sample is written and dealt to ``FIT_PARTS`` tasks, as a limit leaves it in one.
    """
    units = _unit(vectors, "point_id", "embedding").withColumn("_h", F.xxhash64("point_id"))
    some = written(units.orderBy("_h", "point_id").limit(sample).repartition(FIT_PARTS, "point_id")).select(array_to_vector("unit").alias("v"))
    return KMeans(k=lists, featuresCol="v", predictionCol="list", distanceMeasure="cosine", maxIter=15, seed=seed).fit(some)


def ivf_topk(queries: DataFrame, vectors: DataFrame, model: KMeansModel, k: int, probes: int) -> DataFrame:
    """Approximate search: every vector lies in the list of its nearest centre; a query reads ``probes`` lists, ranked exactly.

    Recall against ``cosine_topk`` grows with the share of lists that are read; measure it on the data at hand.
    """
    placed = model.transform(_unit(vectors, "point_id", "embedding").withColumn("v", array_to_vector("unit"))).select("point_id", "list")
    placed = written(placed)  # counted, then joined
    centres = F.array(*[F.struct(F.lit(i).alias("list"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in enumerate(model.clusterCenters())])
    near = F.transform(centres, lambda c: F.struct((-cosine(F.col("query"), c["c"])).alias("d"), c["list"].alias("list")))
    probed = queries.select("query_id", F.explode(F.slice(F.array_sort(near), 1, probes)).alias("p")).select("query_id", F.col("p.list").alias("list"))
    left = queries.select("query_id", "query").join(written(probed), "query_id")
    right = vectors.select("point_id", "embedding").join(placed, "point_id")
    return topk(block_topk(left, right, k, cosines, on=("list",)), k, ("query_id",), "point_id")


def store_by_type(vectors: DataFrame, path: str) -> None:
    """Vectors as a table with a partition for each content type, so that a search for some types reads no other file."""
    vectors.write.mode("overwrite").partitionBy("content_type").parquet(path)


def stored_topk(queries: DataFrame, path: str, kinds: tuple[str, ...], k: int, by_type: bool = False) -> DataFrame:
    """``cosine_topk`` over the stored vectors of some content types; the partitions of others are not read."""
    vectors = queries.sparkSession.read.parquet(path).where(F.col("content_type").isin(*kinds))
    return cosine_topk(queries, vectors, k, by_type)


@dataclass(frozen=True)
class Codebook:
    """Centres of the pieces that vectors are cut into; all pieces share them."""

    parts: int
    centres: tuple[tuple[float, ...], ...]


def fit_codebook(vectors: DataFrame, parts: int = 16, size: int = 64, sample: int = 2_000, seed: int = 7) -> Codebook:
    """A codebook of ``size`` centres for ``parts`` equal pieces of unit vectors.

    It is fitted on the pieces of at most ``sample`` vectors, those with the smallest hashes of their id.
    """
    units = _unit(vectors, "point_id", "embedding").withColumn("_h", F.xxhash64("point_id")).orderBy("_h", "point_id").limit(sample)
    width = F.floor(F.size("unit") / parts).cast("int")
    pieces = units.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("unit", p * width + 1, width))).alias("piece"))
    model = KMeans(k=size, featuresCol="v", maxIter=15, seed=seed).fit(pieces.select(array_to_vector("piece").alias("v")))
    return Codebook(parts, tuple(tuple(float(x) for x in c) for c in model.clusterCenters()))


def _products(vector: Column, book: Codebook) -> Column:
    """array<array<double>>: the products of each piece of a vector with all centres."""
    width = len(book.centres[0])
    centres = F.array(*[F.array(*[F.lit(x) for x in c]) for c in book.centres])
    piece = lambda p: F.transform(centres, lambda c: reduce(lambda a, b: a + b, [vector[p * width + i] * c[i] for i in range(width)]))
    return F.array(*[piece(p) for p in range(book.parts)])


def quantize(vectors: DataFrame, book: Codebook) -> DataFrame:
    """point_id, codes: the nearest centre of each piece of the unit vectors."""
    half = F.array(*[F.lit(sum(x * x for x in c) / 2) for c in book.centres])
    near = lambda products: F.zip_with(half, products, lambda h, x: h - x)  # noqa: E731  half the squared distance, but for what all share
    codes = F.transform(F.col("products"), lambda p: (F.array_position(near(p), F.array_min(near(p))) - 1).cast("int"))
    return _unit(vectors, "point_id", "embedding").select("point_id", _products(F.col("unit"), book).alias("products")).select("point_id", codes.alias("codes"))


def pq_topk(queries: DataFrame, vectors: DataFrame, codes: DataFrame, book: Codebook, k: int, rerank: int) -> DataFrame:
    """Approximate search: all codes are scored by look-ups in each query's table of products, the ``rerank`` best
    vectors of a query are then compared in full.

    Codes and tables meet block by block (``block_topk``); a code takes ``parts`` small numbers. Measure the recall on the
    data at hand.
    """
    tables = _unit(queries, "query_id", "query").select("query_id", F.flatten(_products(F.col("unit"), book)).alias("table"))
    near = block_topk(tables, codes.select("point_id", "codes"), rerank, looked_up, digits=None)
    best = topk(near, rerank, ("query_id",), "point_id").select("query_id", "point_id")
    both = best.join(vectors.select("point_id", "embedding"), "point_id").join(queries, "query_id")
    return topk(both.select("query_id", "point_id", F.round(cosine(F.col("query"), F.col("embedding")), 8).alias("score")), k, ("query_id",), "point_id")


def fact_text(*columns: str) -> Column:
    """What is embedded of a fact: its parts that are there, each on a line."""
    return F.concat_ws("\n", *columns)


def derived_id(kind: str, key: Column) -> Column:
    """A name-based UUID (version 3) of ``KIND:id``."""
    h = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def recheck_facts(hits: DataFrame, facts: DataFrame, key: str = "point_id") -> DataFrame:
    """Hits whose fact is still there and not rejected, ranked anew in the old order."""
    live = facts.where("verification_status <> 'REJECTED'").select(key)
    again = Window.partitionBy("query_id").orderBy("rank")
    return hits.join(live, key, "left_semi").withColumn("rank", F.row_number().over(again))
