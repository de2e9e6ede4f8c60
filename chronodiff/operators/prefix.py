"""Running totals over a global order, or an order within keys, however the rows are spread: ranges, totals, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.session import written


def ranged(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """The rows with ``_range``: in which of Spark's ranges of the order they lie; written, so that the ranges stand.

    Ranges come from a sample of the rows and are as many as shuffle
    partitions, so a range holds its share whatever the input's size, and a key with a third of all rows
    lies over a third of the ranges. Put an id last in the order: then equal values are split too.
    """
    return written(df.repartitionByRange(*(keys or []), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, value: Column, order: list[str], keys: list[str] | None = None, name: str = "total") -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows up to their own, and ``<name>_all``: over all rows of the order.

    Each range is summed by itself; totals of the ranges before come from one
    row a range and key. A key that ends within its range needs none, so what
    is sent to every task is a row a range at most.
    """
    keys = keys or []
    rows = ranged(df.withColumn("_value", value), order, keys)
    inside = F.sum("_value").over(W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    whole = W.partitionBy(*keys)
    sums = rows.groupBy("_range", *keys).agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(whole.orderBy("_range")) - F.col("_sum")).withColumn("_all", F.sum("_sum").over(whole)).withColumn("_parts", F.count("*").over(whole))
    sums = sums.select("_range", *[F.col(k).alias(f"_k_{k}") for k in keys], "_before", "_all", "_parts")
    same = F.col("r._range") == F.col("s._range")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s._k_{k}"))
    spread = sums.where("_parts > 1") if keys else sums
    out = rows.withColumn("_inside", inside).withColumn("_own", F.sum("_value").over(W.partitionBy("_range", *keys))).alias("r").join(F.broadcast(spread).alias("s"), same, "left")
    total = (F.col("_inside") + F.coalesce("_before", F.lit(0))).alias(name)
    return out.select("r.*", total, F.coalesce("_all", "_own").alias(f"{name}_all")).drop("_value", "_range", "_inside", "_own")
