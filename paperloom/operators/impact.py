"""A stored lexical index whose postings lie by impact, and exact top-k search that leaves out what cannot reach the k-th score.

The part of a BM25 score that does not depend on the question (term frequency and length) is a posting's boost. Boosts are
cut into ``LEVELS`` levels. The index keeps, in tables that are bucketed so that searches join them without a shuffle:

* ``postings`` (term, salt, level, key, boost), by term and salt: a salt from the chunk parts the rows of a common term;
* ``terms`` (term, df, levels), by term: how many postings each level has and the largest boost in it;
* ``forward`` (key, terms), by chunk: the chunk's terms with their boosts.

Search, for a batch of questions:

1. The levels with the largest contributions of each question are read first; their chunks are scored exactly, and the
   k-th score is the threshold, which no result may fall below.
2. For each question a cut is chosen for every term, so that the contributions below all cuts together stay under
   the threshold: a chunk that is nowhere above a cut is no result. Levels are given up in order of postings spared for
   each unit of score. Postings above the cuts are read and added up; a chunk whose sum and what its other terms may
   add at most miss the threshold is dropped.
3. The chunks left are scored exactly by their forward rows, in blocks of questions and chunks (``sparse_topk``). A block
   may hold pairs that were left out: their scores are below the threshold, so they change nothing.

Ties and scores are those of ``lexical.topk`` over ``lexical.bm25``, as scores are rounded to 8 places before ranking.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.operators.blocks import sparse_topk
from paperloom.operators.lexical import BROADCAST_TERMS, corpus_stats, postings, tokenize, topk
from paperloom.sources.scratch import shared_folder

LEVELS = 32
SALTS = 8
#: Postings that are read for a question, about, before its threshold is known, for each of the k results.
SEEDS = 12
#: Scores are sums in any order: bounds are compared with this much room.
ROOM = 1e-6


@dataclass(frozen=True)
class ImpactIndex:
    postings: DataFrame
    terms: DataFrame
    forward: DataFrame
    stats: DataFrame
    key: str


def _stored(df: DataFrame, root: str, name: str, by: list[str], buckets: int) -> DataFrame:
    """``df`` as an external table in the shared folder with ``buckets`` files, bucketed by ``by``."""
    table = f"paperloom_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, by[0], *by[1:])
    writer.option("path", f"{root}/{name}").saveAsTable(table)
    return df.sparkSession.table(table)


def build_impact_index(chunks: DataFrame, key: str = "chunk_id", text: str = "content", buckets: int | None = None) -> ImpactIndex:
    """The index of all ``chunks``; ``buckets`` files for each table, as many as there are shuffle partitions if not given.

    Give as many buckets as keep a file at some 100 MB. Tables lie in the shared folder until it is cleared.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = shared_folder(spark)
    stats = corpus_stats(chunks, key, text)
    stats.write.parquet(f"{root}/stats")
    stats = spark.read.schema(stats.schema).parquet(f"{root}/stats")
    tf, k1, b = F.col("tf"), rules.K1, rules.B
    boost = (k1 + 1) * tf / (k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")) + tf)
    posts = postings(chunks, key, text).crossJoin(F.broadcast(stats)).select(F.col(key).alias("key"), "term", boost.alias("boost"))
    level = F.least(F.floor(F.col("boost") * (LEVELS / (k1 + 1))), F.lit(LEVELS - 1)).cast("int")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    posts = _stored(posts.select("term", salt.alias("salt"), level.alias("level"), "key", "boost"), root, "postings", ["term", "salt"], buckets)
    levels = posts.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("boost").alias("most"))
    terms = levels.groupBy("term").agg(F.sum("n").alias("df"), F.array_sort(F.collect_list(F.struct("level", "n", "most"))).alias("levels"))
    terms = _stored(terms, root, "terms", ["term"], buckets)
    forward = _stored(posts.groupBy("key").agg(F.collect_list(F.struct("term", "boost")).alias("terms")), root, "forward", ["key"], buckets)
    return ImpactIndex(posts, terms, forward, stats, key)


def question_weights(questions: DataFrame, index: ImpactIndex, question: str = "question", qkey: str = "question_id") -> DataFrame:
    """qkey, term, w (repetitions times idf) and levels of every term of the questions that the index has."""
    asked = tokenize(questions, qkey, question).select(qkey, F.explode("tokens").alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("qtf"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return asked.join(index.terms, "term").crossJoin(F.broadcast(index.stats)).select(qkey, "term", (F.col("qtf") * idf).alias("w"), "levels")


def _read(index: ImpactIndex, wanted: DataFrame, qkey: str, fits: Column) -> DataFrame:
    """The postings of ``wanted`` (qkey, term, w, ...) for which ``fits`` holds. Only ``wanted`` is moved."""
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.postings.join(salted.hint("shuffle_hash"), ["term", "salt"]).where(fits)


def _best(index: ImpactIndex, keys: DataFrame, weights: DataFrame, k: int, qkey: str) -> DataFrame:
    """qkey, key, score, rank: the ``k`` best of the chunks ``keys`` (key, each once) for each question, from their forward rows.

    A chunk's terms are taken out of its row once for all questions, and only those that some question asks for.
    """
    asked = weights.select("term").distinct()
    if asked.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    rows = index.forward.join(keys, "key", "left_semi").select(F.col("key").alias("point_id"), F.explode("terms").alias("t")).select("point_id", "t.term", F.col("t.boost").alias("x"))
    best = sparse_topk(weights.select(F.col(qkey).alias("query_id"), "term", "w"), rows.join(asked, "term", "left_semi").select("point_id", "term", "x"), k)
    return topk(best.select(F.col("query_id").alias(qkey), F.col("point_id").alias("key"), "score"), k, (qkey,), "key")


def entries(weights: DataFrame, qkey: str) -> DataFrame:
    """qkey, term, w, level, n, most (largest contribution of the level), step and ratio: the levels of each question's terms.

    Giving up a term up to a level costs the level's ``most``, its own share of which is ``step``. ``ratio`` is what the
    best such choice, up to this level or a later one, spares in postings for each unit of score; it falls from level
    to level.
    """
    rows = weights.select(qkey, "term", "w", F.explode("levels").alias("l")).select(qkey, "term", "w", "l.level", "l.n", (F.col("w") * F.col("l.most")).alias("most"))
    term = Window.partitionBy(qkey, "term").orderBy("level")
    rows = rows.withColumn("step", F.col("most") - F.coalesce(F.lag("most").over(term), F.lit(0.0)))
    spared = F.sum("n").over(term.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.greatest("most", F.lit(1e-12))
    return rows.withColumn("ratio", spared).withColumn("ratio", F.max("ratio").over(term.rowsBetween(Window.currentRow, Window.unboundedFollowing)))


def seeds(weights: DataFrame, k: int, qkey: str) -> DataFrame:
    """qkey, term, at (level), n: the levels with the largest contributions, which are read for the threshold."""
    most = Window.partitionBy(qkey).orderBy(F.desc("most"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    rows = entries(weights, qkey).withColumn("before", F.coalesce(F.sum("n").over(most), F.lit(0))).where(F.col("before") < SEEDS * k)
    return rows.select(qkey, "term", F.col("level").alias("at"), "n")


def seed_keys(index: ImpactIndex, first: DataFrame, qkey: str) -> DataFrame:
    """The chunks of the levels ``first``. As an equality the level would be a key of the join, and all postings would be
    shuffled, as they lie by term and salt only."""
    return _read(index, first, qkey, F.col("level").between(F.col("at"), F.col("at"))).select("key").distinct()


def cuts(weights: DataFrame, threshold: DataFrame, qkey: str) -> DataFrame:
    """qkey, term, w, cut (first level that is read), below (the most that a posting below it adds), n (postings above)."""
    spared = Window.partitionBy(qkey).orderBy(F.desc("ratio"), "term", "level")
    rows = entries(weights, qkey).join(threshold, qkey, "left").withColumn("spent", F.sum("step").over(spared))
    gone = F.coalesce(F.col("spent") < F.col("threshold") - ROOM, F.lit(False))
    return rows.groupBy(qkey, "term", "w").agg(
        F.coalesce(F.max(F.when(gone, F.col("level"))) + 1, F.lit(0)).alias("cut"), F.coalesce(F.max(F.when(gone, F.col("most"))), F.lit(0.0)).alias("below"), F.sum(F.when(gone, 0).otherwise(F.col("n"))).alias("n"), F.max("threshold").alias("threshold")
    )


def impact_topk(questions: DataFrame, index: ImpactIndex, k: int, question: str = "question", qkey: str = "question_id", told: dict | None = None) -> DataFrame:
    """qkey, the index's key, score and rank of the ``k`` best chunks of each question, exactly.

    ``told`` gets the tables ``seeds`` and ``cuts``, whose ``n`` says what is read, and ``candidates``.
    """
    spark = questions.sparkSession
    root = shared_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    weights = written(question_weights(questions, index, question, qkey), "weights")
    first = written(seeds(weights, k, qkey), "seeds")
    keys = written(seed_keys(index, first, qkey), "first")
    best = _best(index, keys, weights, k, qkey)
    threshold = written(best.where(F.col("rank") == k).select(qkey, F.col("score").alias("threshold")), "threshold")
    chosen = written(cuts(weights, threshold, qkey), "cuts")
    rest = chosen.groupBy(qkey).agg(F.sum("below").alias("rest"), F.max("threshold").alias("threshold"))
    found = _read(index, chosen.where("n > 0"), qkey, F.col("level") >= F.col("cut"))
    found = found.groupBy(qkey, "key").agg(F.sum(F.col("w") * F.col("boost") - F.col("below")).alias("over"))
    pairs = found.join(rest, qkey).where((F.col("over") + F.col("rest") >= F.col("threshold") - ROOM) | F.col("threshold").isNull()).select(qkey, "key")
    if told is not None:
        pairs = written(pairs, "candidates")
        told |= {"seeds": first, "cuts": chosen, "candidates": pairs}
    keys = written(pairs.select("key").distinct(), "keys")
    return _best(index, keys, weights, k, qkey).withColumnRenamed("key", index.key)
