"""Questions to a change history: lists, searches, counts, reports, streaks, pointers, inheritance, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronodiff.functions.urls import normalize_url

#: What a time that never was sorts as.
NEVER = "0001-01-01 00:00:00"
#: Sort orders of a list and how each value is compared; ties go to the id.
SORTS = {
    "id": lambda: F.col("id"), "name": lambda: F.lower(F.coalesce("name", F.lit(""))), "url": lambda: F.lower(F.coalesce("url", F.lit(""))),
    "status": lambda: F.coalesce("status", F.lit("")), "errors": lambda: F.coalesce("errors", F.lit(0)), "balance": lambda: F.coalesce("balance", F.lit(-1e18)),
    **{c: (lambda c=c: F.coalesce(c, F.lit(NEVER).cast("timestamp"))) for c in ("last_changed", "last_checked", "next_due")},
}


def like_text(col: Column, needle: str) -> Column:
    """Contains, without regard to case; ``%`` and ``_`` are plain characters."""
    return F.lower(col).contains(needle.lower())


def list_filters(folders: list[int] | None = None, status: str | None = None, unread: bool | None = None, text: str | None = None, kind: str | None = None, min_errors: int | None = None,
                 more_text: str | None = None, enabled: bool | None = None, method: str | None = None, plugin: str | None = None, changed_since=None) -> list[Column]:  # noqa: ANN001
    """One predicate for each filter that is set; a saved search is such a list.

    ``text`` and ``more_text`` are looked for in name and address, and both
    must occur. Whether a page has unread keyword hits is ``list_pages``' table
    of changes.
    """
    out = []
    if folders is not None:
        out.append(F.col("folder").isin(folders) if folders else F.lit(False))
    if status is not None:
        out.append(F.col("status") == status)
    if unread is not None:
        out.append(F.col("unread") == unread)
    for needle in (text, more_text):
        if needle:
            out.append(like_text(F.col("name"), needle) | like_text(F.col("url"), needle))
    for column, value in (("kind", kind), ("enabled", enabled), ("method", method), ("plugin", plugin)):
        if value is not None:
            out.append(F.col(column) == value)
    if changed_since is not None:
        out.append(F.col("last_changed") >= F.lit(changed_since))
    if min_errors is not None:
        out.append(F.col("errors") >= min_errors)
    return out


def list_total(pages: DataFrame, filters: list[Column], changes: DataFrame | None = None) -> DataFrame:
    """``total``: how many pages a list has."""
    return list_pages(pages, filters, changes).agg(F.count("*").alias("total"))


def later_start(saved, asked):  # noqa: ANN001, ANN201
    """Of the starts of a saved search and of what is asked on top, the later one; an open one does not count."""
    return max((x for x in (saved, asked) if x is not None), default=None)


def narrow(saved: list[Column], explicit: list[Column]) -> Column:
    """Both filter sets hold; what contradicts matches nothing."""
    return reduce(lambda a, b: a & b, [*saved, *explicit], F.lit(True))


def list_pages(pages: DataFrame, filters: list[Column], changes: DataFrame | None = None) -> DataFrame:
    """Pages for which all filters hold and, with ``changes`` (``page``), that have such a change."""
    out = pages.where(narrow(filters, []))
    return out if changes is None else out.join(changes.select(F.col("page").alias("id")), "id", "left_semi")


def page_after(df: DataFrame, sort: str, desc: bool, cursor: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after the cursor (sort value, id); a top-k, never a whole sort."""
    key = SORTS[sort]()
    if cursor is not None:
        value, last = F.lit(cursor[0]), F.lit(cursor[1])
        beyond = (key < value) if desc else (key > value)
        same = (key == value) & ((F.col("id") < last) if desc else (F.col("id") > last))
        df = df.where(beyond | same)
    order = [key.desc(), F.col("id").desc()] if desc else [key.asc(), F.col("id").asc()]
    return df.orderBy(*order).limit(limit)


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """``id`` and ``depth`` of a folder and all below it."""
    folders.createOrReplaceTempView("chronodiff_folders")
    return folders.sparkSession.sql(
        "WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM chronodiff_folders WHERE id = :root UNION ALL "
        "SELECT f.id, t.depth + 1 FROM t JOIN chronodiff_folders f ON f.parent = t.id) SELECT id, depth FROM t", {"root": root},
    )


def folder_paths(folders: DataFrame) -> DataFrame:
    """``id`` and ``path``: names from the root down, joined by a slash."""
    folders.createOrReplaceTempView("chronodiff_folders")
    return folders.sparkSession.sql(
        "WITH RECURSIVE t(id, path) AS (SELECT id, name FROM chronodiff_folders WHERE parent IS NULL UNION ALL "
        "SELECT f.id, concat_ws('/', t.path, f.name) FROM t JOIN chronodiff_folders f ON f.parent = t.id) SELECT id, path FROM t"
    )


def search_counts(pages: DataFrame, searches: dict[str, list[Column]]) -> DataFrame:
    """``search``, ``total``, ``unread`` of every saved search, in one pass over the pages."""
    aggs = []
    for name, filters in searches.items():
        hit = narrow(filters, [])
        aggs += [F.count_if(hit).alias(f"{name}_total"), F.count_if(hit & F.col("unread")).alias(f"{name}_unread")]
    stack = ", ".join(f"'{n}', {n}_total, {n}_unread" for n in searches)
    return pages.agg(*aggs).selectExpr(f"stack({len(searches)}, {stack}) as (search, total, unread)")


def page_counts(pages: DataFrame) -> DataFrame:
    """Totals and unread pages per folder, and over all (``folder`` null)."""
    return pages.rollup("folder").agg(F.count("*").alias("total"), F.count_if("unread").alias("unread"))


def latest_per(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key`` and the ``value`` of its row with the largest ``order``; no window, no sort."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def newest(df: DataFrame, key: Column | str, order: str, n: int, before: int | None = None) -> DataFrame:
    """The newest n rows of each key, before an order value if given."""
    rows = df if before is None else df.where(F.col(order) < before)
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("nth") <= n)


def unread_hits(changes: DataFrame, page: str, hits: str, at: str) -> DataFrame:
    """``page`` and its distinct hits of unread changes, newest first."""
    each = changes.select(page, at, F.explode(hits).alias("hit")).groupBy(page, "hit").agg(F.max(at).alias("at"))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("at", "hit")), asc=False), lambda x: x["hit"])
    return each.groupBy(page).agg(ranked.alias("hits"))


def report_changed(changes: DataFrame, pages: DataFrame, since) -> DataFrame:  # noqa: ANN001
    """Changes strictly after the marker with their page, and the marker that follows (newest listed)."""
    listed = changes.where(F.col("at") > since)
    marker = F.broadcast(listed.agg(F.max("at").alias("next_marker")))  # one row
    return listed.join(pages, listed["page"] == pages["id"]).join(marker, F.lit(True)).select("change", "page", "name", "at", "next_marker")


def report_all(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Every page with its newest change and how many are unread; pages without a change are listed too."""
    last = changes.groupBy("page").agg(F.max("at").alias("last_change"), F.count_if("is_unread").alias("unread_changes"))
    return pages.join(last, pages["id"] == last["page"], "left").select("id", "name", "status", "last_change", F.coalesce("unread_changes", F.lit(0)).alias("unread_changes"))


def report_errors(pages: DataFrame, runs: DataFrame, is_error: Column) -> DataFrame:
    """Pages in error, in need of a login, or with errors counted: ``id``, ``name``, ``status``, ``errors`` and the ``reason`` of their last failing run, else their status."""
    last = runs.where(is_error).groupBy("page").agg(F.max_by("reason", "run").alias("reason"))
    bad = pages.where(F.col("status").isin("error", "needs_login") | (F.col("errors") > 0))
    reason = F.coalesce(F.nullif(F.col("reason").cast("string"), F.lit("")), "status")
    return bad.join(last, bad["id"] == last["page"], "left").select("id", "name", "status", "errors", reason.alias("reason"))


def newest_failures(pages: DataFrame, runs: DataFrame, is_error: Column) -> DataFrame:
    """Pages whose newest run failed, with its time and outcome and the failures in all."""
    last = runs.groupBy("page").agg(F.max(F.struct("at", "run", "outcome", is_error.alias("failed"))).alias("last"), F.count_if(is_error).alias("failures"))
    bad = last.where("last.failed").select("page", F.col("last.at").alias("at"), F.col("last.outcome").alias("outcome"), "failures")
    return pages.join(bad, pages["id"] == bad["page"]).select("id", "name", "at", "outcome", "failures")


def problems(pages: DataFrame, runs: DataFrame, is_error: Column, actions: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(the newest problems, their ``total``): pages in error or in need of a login, and failed actions.

    Items have ``kind``, ``id`` (page), ``name``, ``message``, ``at``, newest
    first, then by page downwards. ``actions`` has page, message, at. Each kind is cut to ``limit`` before both are ordered.
    """
    limit = max(1, min(limit, 1000))
    last = runs.where(is_error).groupBy("page").agg(F.max_by(F.struct("reason", "at"), "run").alias("l"))
    bad = pages.where(F.col("status").isin("error", "needs_login")).join(last, pages["id"] == last["page"], "left")
    login = F.col("status") == "needs_login"
    message = F.coalesce(F.col("l.reason").cast("string"), F.when(login, "needs login").otherwise("unknown error"))
    a = bad.select(F.when(login, "needs_login").otherwise("page_error").alias("kind"), "id", "name", message.alias("message"), F.col("l.at").alias("at"))
    failed = actions.join(pages.select("id", "name"), actions["page"] == F.col("id"))
    b = failed.select(F.lit("action_failed").alias("kind"), "id", "name", F.coalesce("message", F.lit("the action failed")).alias("message"), "at")
    newest = lambda d: d.orderBy(F.desc("at"), F.desc("id"), "kind", "message").limit(limit)
    return newest(newest(a).unionByName(newest(b))), a.select("id").unionByName(b.select("id")).agg(F.count("*").alias("total"))


def recent_counts(changes: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """``unread_hit_pages``: pages with an unread change that has hits; ``changed_day``: pages changed in the 24 hours before."""
    day = (F.col("at") > F.lit(now).cast("timestamp") - F.expr("interval 24 hours")) & (F.col("at") <= F.lit(now).cast("timestamp"))
    return changes.agg(
        F.countDistinct(F.when(F.col("is_unread") & F.col("hit").isNotNull(), F.col("page"))).alias("unread_hit_pages"), F.countDistinct(F.when(day, F.col("page"))).alias("changed_day")
    )


def error_streaks(runs: DataFrame, page: str, at: list[str], error: Column, threshold: int = 3) -> DataFrame:
    """``streak`` of consecutive errors up to each run and the ``status`` it gives.

    The first error of a streak is retried and not counted; a success resets.
    """
    order = W.partitionBy(page).orderBy(*at)
    island = F.sum((~error).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    runs = runs.withColumn("island", island).withColumn("is_error", error)
    inside = W.partitionBy(page, "island").orderBy(*at).rowsBetween(W.unboundedPreceding, 0)
    streak = F.greatest(F.sum(F.col("is_error").cast("int")).over(inside) - 1, F.lit(0))
    streak = F.when(F.col("is_error"), streak).otherwise(0)
    return runs.withColumn("streak", streak.cast("int")).withColumn("status", F.when(F.col("streak") >= threshold, "error").when(F.col("streak") > 0, "warning").otherwise("ok")).drop("island", "is_error")


def pointers(versions: DataFrame, reads: DataFrame, alerts: DataFrame) -> DataFrame:
    """``latest``, ``baseline`` (version at the last read) and ``anchor`` (at the last read or alert) of each page.

    All three are ``page``, ``at`` tables; versions have ``version``.
    """
    last_read = reads.groupBy("page").agg(F.max("at").alias("read_at"))
    last_alert = alerts.groupBy("page").agg(F.max("at").alias("alert_at"))
    rows = versions.join(last_read, "page", "left").join(last_alert, "page", "left")
    moved = F.greatest("read_at", "alert_at")
    return rows.groupBy("page").agg(
        F.max_by("version", "at").alias("latest"),
        F.max_by(F.when(F.col("at") <= F.col("read_at"), F.col("version")), F.when(F.col("at") <= F.col("read_at"), F.col("at"))).alias("baseline"),
        F.max_by(F.when(F.col("at") <= moved, F.col("version")), F.when(F.col("at") <= moved, F.col("at"))).alias("anchor"),
    )


def mark_read(changes: DataFrame, page_ids: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """Changes with ``read_at`` set where the page is in ``page_ids`` (``page``) and none was set."""
    ids = page_ids.select(F.col("page").alias("read_page")).distinct()
    joined = changes.join(ids, changes["page"] == ids["read_page"], "left")
    fresh = F.col("read_at").isNull() & F.col("read_page").isNotNull()
    return joined.withColumn("read_at", F.when(fresh, F.lit(now)).otherwise(F.col("read_at"))).drop("read_page")


def mark_pages_read(pages: DataFrame, page_ids: DataFrame) -> DataFrame:
    """Pages as they are once those in ``page_ids`` (``page``) are read, and ``was_unread``.

    Their latest version becomes baseline and anchor, ``unread`` and the count
    of errors are cleared, ``changed`` becomes ``ok``, and ``error`` becomes
    ``ok``, or ``new`` where there is no version. Other pages stay as they are.
    """
    ids = page_ids.select(F.col("page").alias("read_page")).distinct()
    out = pages.join(ids, pages["id"] == ids["read_page"], "left")
    read = F.col("read_page").isNotNull()
    status = F.when(F.col("status") == "changed", "ok").when(F.col("status") == "error", F.when(F.col("latest").isNotNull(), "ok").otherwise("new")).otherwise(F.col("status"))
    was = read & (F.col("unread") | ~F.col("baseline").eqNullSafe(F.col("latest")))
    own = {"baseline": F.col("latest"), "anchor": F.col("latest"), "unread": F.lit(False), "errors": F.lit(0).cast(pages.schema["errors"].dataType), "status": status}
    return out.withColumns({"was_unread": was} | {c: F.when(read, v).otherwise(F.col(c)) for c, v in own.items()}).drop("read_page")


def stale_pages(runs: DataFrame, page: str, at: str, changed: Column, days: int) -> DataFrame:
    """One row for each quiet period of a page: its last change and the first run ``days`` or more later."""
    order = W.partitionBy(page).orderBy(at)
    runs = runs.withColumn("since", F.last(F.when(changed, F.col(at)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    quiet = runs.where(F.col(at) >= F.col("since") + F.make_dt_interval(days=F.lit(days)))
    return quiet.groupBy(page, "since").agg(F.min(at).alias("alert_at"))


def resolve_config(chain: DataFrame, key: str) -> DataFrame:
    """The effective value of each setting: ``key``, ``path``, ``value``.

    ``chain`` has a row for every level above a page (``depth`` grows towards
    the page), setting and value; the nearest level wins, and a nearest null
    removes the setting.
    """
    best = chain.groupBy(key, "path").agg(F.max_by(F.struct("value"), "depth")["value"].alias("value"))
    return best.where("value is not null")


def dedupe_import(new: DataFrame, existing: DataFrame, order: str, url: str = "url") -> DataFrame:
    """``new`` with ``outcome``: error (no address), skipped (known or repeated), created. The first row wins."""
    rows = new.withColumn("norm", normalize_url(F.col(url)))
    known = existing.select(normalize_url(F.col(url)).alias("norm")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "norm", "left").withColumn("nth", F.row_number().over(W.partitionBy("norm").orderBy(order)))
    valid = F.col(url).rlike("^https?://[^/]+")
    return rows.withColumn("outcome", F.when(~valid, "error").when(F.col("known") | (F.col("nth") > 1), "skipped").otherwise("created")).drop("known", "nth")


def folder_tree(spark: SparkSession, region: DataFrame, nation: DataFrame) -> DataFrame:
    """A folder tree of three levels (``id``, ``parent``, ``name``) from two dimension tables."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("all").alias("name"))
    mid = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name"))
    low = nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name"))
    return root.unionByName(mid).unionByName(low)
