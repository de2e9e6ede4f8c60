"""Cutting lineage through the shared folder, and connected components on edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.session import shared_folder


#: Rows and bytes that reach a Python task at once, where the session has not set its own.
BATCH_ROWS, BATCH_BYTES = 2000, "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; long texts would make the default ones too large for a task."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Whatever reads the result later starts from that table, so an executor
    that is lost costs the tasks it ran and not the plan above.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronodiff-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node that each node can reach, from undirected edges ``a``, ``b``.

    Large-star and small-star steps alternate: a node hands the smallest
    neighbour it knows to its larger neighbours, then to its smaller ones.
    Every step is an aggregation with map-side combining and a join that Spark
    may split where a node has very many edges. The rounds stop when the edge
    set no longer changes. Returns ``node``, ``component`` for nodes that have
    an edge to another node; self-loops and null ends are dropped.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = cut(pairs, "edges")
    digest = None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == digest or state[0] == 0:
            break
        digest = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.select(F.col("u").alias("node"), "component").unionByName(roots)
