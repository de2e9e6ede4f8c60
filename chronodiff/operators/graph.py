"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.session import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node with an edge to another (``a``, ``b``).

    Large-star and small-star steps by turns: every node hands the smallest
    neighbour it knows to the larger ones, then to the smaller ones. Rounds
    follow the logarithm of the longest path. A round is two aggregations with map-side
    combining; its edges are written, so plans stay short.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col("u").alias("node"), "component").unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
