"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc", a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``links``; comp is the smallest node that it reaches.

    Every round writes its edges to the shared folder, so lineage stays short and a lost executor costs one round. The
    edges never outnumber the links; rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen, turn = scratch.write(edges, f"{name}_0"), None, 0
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if not state["n"] or (state["n"], state["s"]) == seen:
            break
        seen, turn = (state["n"], state["s"]), turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), f"{name}_{turn}")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
