r"""N-gram Jaccard join (operator 6): an exact similarity self-join of word-shingle sets by a grouped prefix join.

A document's set holds the distinct shingles of ``k`` words (A-Z lower-cased); a text with fewer words is one shingle,
one without words has an empty set and links with nothing. Two documents link when the intersection of their sets is
``percent`` or more of the union. The result gives every document its component: the smallest document id reachable by
links.

1. Shingle counts over all documents. Each batch of documents sends its shingle hashes, packed and deduplicated with
   counts, to buckets of the hash space; a bucket finds the shingles of more than ``FREQUENT`` documents. Frequent
   shingles come last in the global order of the prefix filter; all others are ordered by hash. Any order gives exact
   results; this one keeps a passage that a large part of the corpus shares from meeting everybody with everybody.
   Should there be more than ``MAX_FREQUENT`` frequent ones, only the most frequent are put last.
2. Prefixes. Two sets of the wanted similarity share one of their first n - ceil(percent * n / 100) + 1 shingles.
   Documents with equal sets become one member, members with equal prefix and size one group, and only groups are
   indexed: one narrow row for each prefix shingle of a group.
3. Group pairs come from shingles that at most ``FREQUENT`` members share. They are filtered by size and by the largest
   intersection that the counted shared prefix leaves possible, then expanded to members and verified on whole sets.
4. Shingles that more members share hold crowds. A member whose prefix reaches its frequent shingles has all others in
   its prefix, so a pair that was not met in step 3 shares frequent shingles only: whether it links follows from
   the two sets of frequent shingles and the two sizes. Members of equal frequent set and size become one node. Nodes
   are joined by prefixes again, now of their frequent shingles, rarest first, and only as long as the overlap that the
   node's whole size asks for leaves: a set with many shingles of its own has a short one.
5. Shingles that more than ``FREQUENT`` nodes have in these prefixes hold crowds of nodes. Every crowd is first verified
   against its node with the smallest share of shingles of its own, which is the text that the others are copies of
   where there is one; what links becomes one component. While this pays, eight times as many such pivots are taken
   from the nodes outside their crowd's largest component. Then each of those meets the nodes of other components, if
   nothing linked on a second common shingle of the prefixes, one longer for it; a pair is verified if the sizes and a
   bitmap of each set leave a link possible: bits that differ are elements that only one of the two has. No link between
   components is lost, and no cluster is expanded into all its pairs.

Null doc ids take no part in the smallest id. Null text counts as empty. Repeated rows are rows of the same set. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, key_join, released, row_key
from paperloom.llm.components import components
from paperloom.llm.hashing import groups, shingle_sets

FREQUENT = 64
MAX_FREQUENT = 2_000_000
#: Bits of a set's bitmap: each is the parity of the set's shingles that fall to it.
BITS = 1024
#: Shingles that one bucket of the count should hold.
BUCKET_SHINGLES = 250_000
#: Shingles gathered before they are handed on by bucket.
GATHERED = 1_500_000
#: What is left of all crowds is compared at once where that makes so many comparisons for each of their nodes.
PLAIN = 20


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text as sorted 63-bit numbers."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    for lo, hi in groups(raw):
        for s in shingle_sets(raw[lo:hi], k, lower=True):
            yield np.unique(s >> np.uint64(1)).astype(np.int64)


# --- 1. counts


def _packed(k: int, buckets: int):
    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(found) & ((buckets << 32) - 1), return_counts=True)
        edges = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.int64) << 32)
        low = (keys & 0xFFFFFFFF).astype("<u4")
        ids, blobs, many = [], [], []
        for b in np.flatnonzero(np.diff(edges)):
            part, n = low[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]
            at = np.flatnonzero(n > 1)
            ids.append(int(b))
            blobs.append(part.tobytes())
            many.append(np.stack([at, n[at] - 1]).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.array(many, pa.binary())], ["bucket", "keys", "more"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for s in _sets(batch.column(0), k):
                found.append(s)
                size += len(s)
                if size >= GATHERED:
                    yield told(found)
                    found, size = [], 0
        if size:
            yield told(found)

    return rows


def _counted(least: int):
    def rows(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = [], []
        for blob, more in zip(table.column("keys"), table.column("more"), strict=True):
            part = np.frombuffer(blob.as_py(), "<u4")
            n = np.ones(len(part), np.int64)
            at, extra = np.frombuffer(more.as_py(), "<u4").reshape(2, -1)
            n[at] += extra
            keys.append(part)
            counts.append(n)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        hot = total > least
        return pa.table({"key": pa.array((bucket << 32) | key[hot].astype(np.int64), pa.int64()), "n": pa.array(total[hot], pa.int64())})

    return rows


def frequent_shingles(texts: DataFrame, k: int, frequent: int, scratch: Scratch) -> tuple[tuple[np.ndarray, np.ndarray], int, int]:
    """((sorted keys of the frequent shingles, their counts), number of buckets, documents that any other shingle may have).

    A key is the low bits of a shingle's number.
    """
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = 1 << min(max((int(size / 6 / BUCKET_SHINGLES)).bit_length(), 6), 24)
    counted = texts.select("_text").mapInArrow(released(_packed(k, buckets)), "bucket int, keys binary, more binary")
    counted = scratch.write(counted.groupBy("bucket").applyInArrow(_counted(frequent), "key long, n long"), "frequent")
    levels = counted.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    least, total = frequent + 1, 0
    for r in levels:
        total += r["count"]
        if total > MAX_FREQUENT:
            least = 2 << int(r["level"])
            break
    found = counted.where(F.col("n") >= least).select("key", "n").toPandas()  # MAX_FREQUENT rows at most
    keys, counts = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return (keys[order], counts[order]), buckets, least - 1


# --- 2. prefixes


def _frequent(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(which shingles of a set are frequent, the counts of these)."""
    keys, counts = frequent
    if not len(keys):
        return np.zeros(len(s), bool), np.empty(0, np.int64)
    key = s & ((buckets << 32) - 1)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hot = keys[at] == key
    return hot, counts[at[hot]]


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _prefixes(k: int, percent: int, sent, buckets: int):
    """Rows of (id, row key, set size, set digest, group, prefix in global order)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        low = np.int64(np.iinfo(np.int64).min)
        for batch in batches:
            sizes, digests, gids, prefixes, own = [], [], [], [], []
            for s in _sets(batch.column(2), k):
                n = len(s)
                sizes.append(n)
                if not n:
                    digests.append(None), gids.append(None), prefixes.append(None), own.append(0)
                    continue
                order = s + low  # below zero: not frequent
                hot, _ = _frequent(s, frequent, buckets)
                if hot.any():
                    order = np.concatenate([order[~hot], s[hot]])
                own.append(int((order < 0).sum()))
                prefix = order[: n - -(-percent * n // 100) + 1]
                digests.append(_digest(s))
                gids.append(_digest(np.concatenate([prefix, [n]])))
                prefixes.append(prefix)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(gids, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(own, pa.int32())],
                ["_id", "_rid", "n", "fp", "gid", "prefix", "own"],
            )

    return rows


def _tokens(k: int, sent, buckets: int):
    """Rows of (set digest, all shingles, frequent ones first and the rarest of these before others, how many are
    frequent, digest and bitmap of the frequent ones)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo in range(0, len(texts), 500):
                digests, sets, many, common, bits = [], [], [], [], []
                for s in _sets(texts[lo : lo + 500], k):
                    if not len(s):
                        continue
                    hot, counts = _frequent(s, sent.value, buckets)
                    shared = s[hot]
                    digests.append(_digest(s))
                    sets.append(np.concatenate([shared[np.lexsort((shared, counts))], s[~hot]]))
                    many.append(len(shared))
                    common.append(_digest(shared))
                    bits.append(np.packbits(np.bincount(shared & (BITS - 1), minlength=BITS) & 1).view(np.int64))
                columns = [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(many, pa.int32()), pa.array(common, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "tokens", "common", "common_fp", "bits"])

    return rows


# --- 3. to 5. pairs


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose sets, with the digests a and b, link."""
    left = tokens.select(F.col("fp").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("fp").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.where(100 * shared >= percent * (F.size("ta") + F.size("tb") - shared)).select(*pairs.columns)


def _sizes_fit(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _fits(percent: int):
    """Whether the frequent shingles of two nodes, the second one's columns ending in 2, are enough for a link."""
    return (100 + percent) * F.least("common", "common2") >= percent * (F.col("n") + F.col("n2"))


def _linkable(percent: int):
    """Whether two nodes of a crowd may link and are not linked yet."""
    apart_bits = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(BITS // 64)), F.lit(0))
    # The intersection is at most half of the sizes less the elements that only one has.
    most = F.col("common") + F.col("common2") - apart_bits
    return (F.col("comp") != F.col("comp2")) & _fits(percent) & ((100 + percent) * most >= 2 * percent * (F.col("n") + F.col("n2")))


def _needed(percent: int):
    """The least overlap of a node that links."""
    return F.ceil(percent * F.col("n") / 100).cast("int")


def _node_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose nodes, a and b, link by their frequent shingles."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where((100 + percent) * F.size(F.array_intersect("sa", "sb")).cast("long") >= percent * (F.col("na") + F.col("nb"))).select(*pairs.columns)


def _renamed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(c + "2") for c in df.columns if c not in keys])


def crowd_components(crowds: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """(node, comp): what the components ``comp`` of the rows of ``crowds`` become when their links are added.

    ``crowds`` has crowd, fp, n, common, bits and comp; ``sets`` the nodes' frequent shingles. None where there is no
    further link.
    """
    if not crowds.head(1):
        return None
    held = scratch.write(crowds, "crowds")
    edges, became, pivots, turn, linked = None, None, 1, 0, True
    own = (F.col("n") - F.col("common")) / F.col("n")
    while True:
        now = held
        if became is not None:
            now = held.join(became.select(F.col("node").alias("comp"), F.col("comp").alias("_new")), "comp", "left").withColumn("comp", F.coalesce("_new", "comp")).drop("_new")
            now = scratch.write(now.select(*held.columns), f"crowds_{turn}")
        parts = now.groupBy("crowd", "comp").agg(F.count("*").alias("c"))
        main = scratch.write(parts.groupBy("crowd").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")), f"main_{turn}")
        left = main.agg(F.sum("all"), F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()
        apart = now.join(main.select("crowd", "main"), "crowd").where("comp <> main")
        cheap = left[1] <= PLAIN * left[0]
        last = cheap or not linked
        if last:
            # Where nothing links, a crowd is many texts that share a passage: a pair must share a second shingle of the
            # prefixes, too.
            keys = ["crowd"] if cheap else ["crowd", "second"]
            if not cheap:
                after = sets.select("fp", F.explode(F.slice("shared", F.lit(1), F.size("shared") - _needed(percent) + 2)).alias("second"))
                apart, now = (x.join(after, "fp").where("second <> crowd") for x in (apart, now.join(main.where("all > most").select("crowd"), "crowd", "left_semi")))
            tried = apart.join(_renamed(now, *keys), keys).where(_linkable(percent) & ((F.col("comp2") == F.col("main")) | (F.col("fp") < F.col("fp2"))))
        else:
            place = F.row_number().over(Window.partitionBy("crowd").orderBy(own, F.xxhash64("fp"), "fp"))
            source = now if turn == 0 else apart.drop("main")
            best = source.withColumn("place", place).where(F.col("place") <= pivots).drop("place")
            tried = source.join(_renamed(best, "crowd"), "crowd").where(_linkable(percent))
        ends = [F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"), F.least("comp", "comp2").alias("ca"), F.greatest("comp", "comp2").alias("cb")]
        tried = scratch.write(tried.select(*ends).distinct(), f"tried_{turn}")
        more = scratch.write(_node_links(tried, sets, percent).select("ca", "cb").distinct(), f"links_{turn}")
        linked = bool(more.head(1))
        if linked:
            edges = more if edges is None else edges.unionByName(more)
            became = components(edges, scratch, f"cc_{turn}", "ca", "cb")
        if last:
            return became
        pivots, turn = 8 * pivots, turn + 1


def frequent_links(members: DataFrame, tokens: DataFrame, percent: int, limit: int, scratch: Scratch) -> DataFrame | None:
    """(node, comp): what the components ``comp`` of ``members`` (fp, n, comp) become when links by frequent shingles are added.

    None where there is no member.
    """
    if not members.head(1):
        return None
    rows = members.join(tokens.select("fp", "common", "common_fp"), "fp").where(100 * F.col("common") >= percent * F.col("n"))
    rows = scratch.write(rows.withColumn("node", F.unhex(F.md5(F.concat("common_fp", F.col("n").cast("string").cast("binary"))))).select("fp", "n", "comp", "node", "common"), "node_members")
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("common").alias("common"), F.count("*").alias("m"))
    sets = nodes.join(tokens.select("fp", "tokens", "bits"), "fp").select(F.col("node").alias("fp"), "n", "common", "m", F.slice("tokens", F.lit(1), F.col("common")).alias("shared"), "bits")
    sets = scratch.write(sets, "node_sets")
    index = sets.select("fp", "n", "common", F.explode(F.slice("shared", F.lit(1), F.col("common") - _needed(percent) + 1)).alias("tok"))
    weights = index.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    index = scratch.write(index.join(weights, "tok"), "node_index")
    few = index.where(F.col("c") <= limit).drop("c")
    pairs = few.join(_renamed(few, "tok"), "tok").where((F.col("fp") < F.col("fp2")) & _fits(percent)).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    links = scratch.write(_node_links(scratch.write(pairs, "node_pairs"), sets, percent), "node_links")
    comps = components(links, scratch, "cc_nodes").select(F.col("node").alias("fp"), "comp")
    crowds = index.where(F.col("c") > limit).select(F.col("tok").alias("crowd"), "fp").join(sets.select("fp", "n", "common", "bits"), "fp").join(comps, "fp", "left")
    became = crowd_components(crowds.withColumn("comp", F.coalesce("comp", "fp")), sets, percent, scratch)
    edges = links.select("a", "b")
    if became is not None:
        edges = edges.unionByName(became.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    # Members of a node have the same partners; without any they link with each other if their frequent shingles are enough.
    alone = sets.where(F.col("m") > 1).where((100 + percent) * F.col("common") >= 2 * percent * F.col("n")).select("fp")
    linked = scratch.write(edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).union(alone).distinct(), "nodes_linked")
    held = rows.join(linked.withColumnRenamed("fp", "node"), "node").select(F.col("comp").alias("a"), F.col("node").alias("b"))
    return components(edges.unionByName(held), scratch, "cc_frequent")


def ngram_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, frequent: int = FREQUENT, scratch: Scratch | None = None
) -> DataFrame:
    """``key``, n_shingles and component_id for every row of ``docs``, with the row's key ``_rid`` beside them."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    source = docs.select(F.col(key).alias("_id"), row_key(key, text).alias("_rid"), F.col(text).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()

    last, buckets, limit = frequent_shingles(source, k, frequent, scratch)
    sent = spark.sparkContext.broadcast(last)  # MAX_FREQUENT pairs of numbers at most
    ddl = f"_id {id_type}, _rid binary, n int, fp binary, gid binary, prefix array<long>, own int"
    sets = source.mapInArrow(released(_prefixes(k, percent, sent, buckets)), ddl).withColumn("pos", F.monotonically_increasing_id())
    sets = scratch.write(sets, "sets")

    # A group goes by the place of its first row, which is unique.
    members = sets.where("n > 0").groupBy("gid", "n", "fp", "own").agg(F.min("pos").alias("pos"), F.min("_rid").alias("_rid"), F.min("_id").alias("low_id"), F.count("*").alias("copies"))
    members = scratch.write(members, "members")
    grouped = scratch.write(members.groupBy("gid").agg(F.min("pos").alias("g"), F.count("*").alias("m")), "groups")
    members = scratch.write(members.join(grouped.select("gid", "g"), "gid").drop("gid", "pos"), "grouped_members")
    indexed = key_join(sets.select(F.col("pos").alias("g"), "n", "prefix"), grouped.select("g", "m"), "g", "inner")
    info = scratch.write(indexed.select("g", "n", "m", F.size("prefix").alias("k"), F.element_at("prefix", -1).alias("top")), "group_info")

    index = indexed.select(F.explode("prefix").alias("tok"), "g", "n", "m").repartition("tok")
    weights = index.groupBy("tok").agg(F.count("*").alias("c"), F.sum("m").alias("w")).where("c > 1").select("tok", "w")
    shared = scratch.write(index.join(weights, "tok").select("tok", "g", "n", "w"), "shared")
    hot = shared.where(F.col("w") > limit)
    held = scratch.write(hot.groupBy("g").agg(F.count("*").alias("h")), "hot_groups")

    x = shared.where(F.col("w") <= limit)
    y = x.select("tok", F.col("g").alias("g2"), F.col("n").alias("n2"))
    met = x.join(y, "tok").where((F.col("g") < F.col("g2")) & _sizes_fit("n", "n2", percent))
    met = met.groupBy("g", "g2").agg(F.count("*").alias("c"))
    side = info.join(held, "g", "left").select("g", "n", "k", "top", F.coalesce("h", F.lit(0)).alias("h"))
    side = scratch.write(side, "group_side")
    met = key_join(met, side, "g", "inner")
    met = key_join(met, side.select(*[F.col(c).alias(c + "2") for c in side.columns]), "g2", "inner")
    # Up to the end of the prefix that ends first, the shared shingles are counted; the rest is bounded by what is left.
    rest = F.when(F.col("top") <= F.col("top2"), F.col("n") - F.col("k")).otherwise(F.col("n2") - F.col("k2"))
    most = F.col("c") + F.least("h", "h2") + rest
    met = met.where((100 + percent) * most >= percent * (F.col("n") + F.col("n2"))).select("g", "g2")
    one = members.select("g", F.col("fp").alias("a"))
    two = members.select(F.col("g").alias("g2"), F.col("fp").alias("b"))
    pairs = met.join(one, "g").join(two, "g2").select("a", "b")
    few = grouped.where((F.col("m") > 1) & (F.col("m") <= limit)).select("g")
    inside = one.join(few, "g", "left_semi")
    inside = inside.join(inside.select("g", F.col("a").alias("b")), "g").where("a < b").select("a", "b")
    pairs = scratch.write(pairs.unionByName(inside).distinct(), "pairs")

    # A member links by frequent shingles only if these make up enough of its set.
    large = grouped.where(F.col("m") > limit).select("g")
    crowded = members.join(hot.select("g").union(large).distinct(), "g", "left_semi")
    crowded = scratch.write(crowded.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")).select("fp", "n"), "crowd_members")
    scratch.drop("shared", "frequent")

    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).union(crowded.select("fp")).distinct()
    rids = scratch.write(members.join(wanted, "fp", "left_semi").select("_rid").distinct(), "wanted")
    tokens = key_join(source, rids, "_rid", "left_semi").select("_text").mapInArrow(released(_tokens(k, sent, buckets)), "fp binary, tokens array<long>, common int, common_fp binary, bits array<long>")
    tokens = scratch.write(tokens.dropDuplicates(["fp"]), "tokens")
    sent.unpersist()

    links = scratch.write(_verified(pairs, tokens, percent), "links")
    comps = components(links, scratch, "cc_pairs")
    crowded = crowded.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    became = frequent_links(crowded, tokens, percent, limit, scratch)

    owned = members.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_id", "copies", F.coalesce("comp", "fp").alias("comp"), F.col("comp").isNotNull().alias("linked"))
    if became is not None:
        owned = owned.join(became.select(F.col("node").alias("comp"), F.col("comp").alias("_new")), "comp", "left")
        owned = owned.select("fp", "low_id", "copies", F.coalesce("_new", "comp").alias("comp"), (F.col("linked") | F.col("_new").isNotNull()).alias("linked"))
    lows = owned.where("linked").groupBy("comp").agg(F.min("low_id").alias("component_id"))
    labels = owned.where("linked OR copies > 1").join(lows, "comp", "left").select("fp", F.coalesce("component_id", "low_id").alias("component_id"))
    labels = scratch.write(labels, "labels")
    scratch.drop("tokens", "members", "grouped_members", "pairs", "crowds", "node_sets", "node_index", "node_members")
    out = key_join(sets.select("_id", "_rid", "n", "fp"), labels, "fp", "left")
    return out.select(F.col("_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), "_rid")
