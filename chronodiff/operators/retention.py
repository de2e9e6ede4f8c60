"""What may go: old versions, unreferenced content, the oldest beyond a disk cap, old log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.operators.prefix import running_total


def prune_versions(versions: DataFrame, pinned: DataFrame, keep: int) -> DataFrame:
    """Versions that may be dropped: not among the newest ``keep`` of their page, and not in ``pinned`` (``version``)."""
    old = versions.withColumn("nth", F.row_number().over(W.partitionBy("page").orderBy(F.desc("at"), F.desc("version")))).where(F.col("nth") > keep)
    return old.join(pinned.select("version"), "version", "left_anti").drop("nth")


def prune_changes(changes: DataFrame, dropped: DataFrame) -> DataFrame:
    """Changes that stay when the ``dropped`` versions go: those whose new version stays.

    A change whose old version goes keeps its row and loses the reference.
    """
    gone = dropped.select(F.col("version").alias("_gone")).distinct()
    left = changes.join(gone, F.col("new_version") == F.col("_gone"), "left_anti")
    marked = left.join(gone, F.col("old_version") == F.col("_gone"), "left")
    return marked.withColumn("old_version", F.when(F.col("_gone").isNull(), F.col("old_version"))).drop("_gone")


def unreferenced(content: DataFrame, refs: list[DataFrame], cutoff) -> DataFrame:  # noqa: ANN001
    """Content (``content``, ``stored_at``) that no table refers to and that is older than the grace period."""
    used = refs[0].select("content")
    for r in refs[1:]:
        used = used.unionByName(r.select("content"))
    return content.where(F.col("stored_at") < cutoff).join(used.distinct(), "content", "left_anti")


def cap_candidates(versions: DataFrame, excess: Column | int, protected: DataFrame | None = None) -> DataFrame:
    """The oldest versions until their new bytes reach ``excess``; each content counts once, with its oldest version.

    ``protected`` (``version``: pinned, latest, baseline, anchor) are passed over.
    The order is one of all versions; see ``prefix.running_total``.
    """
    if protected is not None:
        versions = versions.join(protected.select("version").distinct(), "version", "left_anti")
    first = versions.groupBy("content").agg(F.min(F.struct("at", "version")).alias("f")).select(F.col("f.version").alias("version"), F.lit(True).alias("_first"))
    rows = versions.join(first, "version", "left").withColumn("fresh", F.when(F.col("_first"), F.col("bytes")).otherwise(0)).drop("_first")
    ranked = running_total(rows, F.col("fresh"), ["at", "version"])
    return ranked.where(F.col("total") - F.col("fresh") < excess).drop("total", "total_all")


def purge(df: DataFrame, at: str, cutoff) -> DataFrame:  # noqa: ANN001
    """Log rows that stay: not older than the cutoff."""
    return df.where(F.col(at) >= cutoff)
