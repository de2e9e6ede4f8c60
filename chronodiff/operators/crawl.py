"""Following links: which to take, how far, and what robots rules allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.urls import host_of
from chronodiff.session import written


def select_links(links: DataFrame, include: str | None, exclude: str | None, existing: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Links (``page``, ``base``, ``url``, ``n``) worth following: same host, patterns, not the page itself, not known; each once.

    ``existing`` and ``seen`` have ``url``: pages that are watched, and links that were offered before.
    """
    ok = (host_of(F.col("base")) == host_of(F.col("url"))) & (F.col("url") != F.col("base"))
    if include:
        ok = ok & F.col("url").rlike(include)
    if exclude:
        ok = ok & ~F.col("url").rlike(exclude)
    known = existing.select("url") if seen is None else existing.select("url").unionByName(seen.select("url"))
    fresh = links.where(ok).join(known.distinct(), "url", "left_anti")
    return fresh.groupBy("url").agg(F.min(F.struct("page", "n")).alias("first")).select("url", "first.page", "first.n")


def crawl_frontier(edges: DataFrame, roots: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """``root``, ``node``, ``level``: nodes within ``depth`` links of each root, nearest first, ``max_pages`` a root.

    Each level keeps what a root's budget leaves, by node, before the next join
    over ``edges`` (``src``, ``dst``), so never more than ``max_pages`` nodes of a root are
    expanded; a level is a table of its own, so plans stay short.
    """
    seen = written(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("level")).distinct(), "frontier")
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        spent = seen.groupBy("root").agg(F.count("*").alias("spent"))
        nth = F.row_number().over(W.partitionBy("root").orderBy("node"))  # Spark cuts it to the budget before it shuffles
        first = fresh.withColumn("nth", nth).where(F.col("nth") <= max_pages)
        front = written(first.join(spent, "root").where(F.col("nth") <= max_pages - F.col("spent")).select("root", "node", F.lit(level).alias("level")), "frontier")
        seen = seen.unionByName(front)
    return seen


def robots_allowed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links with ``allowed``: the longest rule path that the link's path begins with decides; no rule allows, and of equal ones the one that allows.

    ``rules`` has host, path, allow; a path is a prefix by characters, so
    ``/the`` closes ``/theatre``. A host's rules (a robots file is half a
    megabyte at most) are one array, so a link meets its host once and the
    prefixes are tested within its row.
    """
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    rows = links.withColumn("host", host_of(F.col("url"))).withColumn("path", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    ours = rules.where("path <> ''").groupBy("host").agg(F.collect_list(F.struct(F.char_length("path").alias("n"), "allow", "path")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return rows.join(ours, "host", "left").withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).select(*links.columns, "host", "path", "allowed")
