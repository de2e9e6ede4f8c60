"""Queries on histories: customers are pages, nations folders, orders changes, events check runs, parts contents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.operators import history as H
from chronodiff.operators import hooks as K
from chronodiff.operators import retention
from chronodiff.plans.registry import query
from chronodiff.session import table
from chronodiff.sources import watchlists as WL

SINCE = dt.datetime(1998, 1, 1)
NOW = dt.datetime(2024, 1, 31)

PAGES = """pages_t AS (SELECT c_custkey AS id, c_nationkey AS folder, c_name AS name, 'https://host' || c_nationkey || '.example.com/' || c_custkey AS url, c_acctbal AS balance,
  CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END AS status, c_acctbal > 5000 AS unread, c_mktsegment AS kind, c_custkey % 7 AS errors FROM customer)"""
CHANGES = """changes_t AS (SELECT o_orderkey AS change, o_custkey AS page, o_orderdate AS moment, o_orderstatus = 'O' AS is_unread, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS read_at, o_orderpriority AS hit FROM orders)"""
RUNS = """runs_t AS (SELECT event_id AS run, user_id AS page, ts AS moment, event_type AS outcome, value AS seconds FROM events)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    url = F.concat(F.lit("https://host"), F.col("c_nationkey").cast("string"), F.lit(".example.com/"), key.cast("string"))
    return c.select(
        key.alias("id"), F.col("c_nationkey").alias("folder"), F.col("c_name").alias("name"), url.alias("url"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") < 0, "error").otherwise("ok").alias("status"), (F.col("c_acctbal") > 5000).alias("unread"), F.col("c_mktsegment").alias("kind"), (key % 7).alias("errors"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = F.col("o_orderstatus") == "O"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("change"), F.col("o_custkey").alias("page"), F.col("o_orderdate").alias("at"), unread.alias("is_unread"),
        F.when(~unread, F.col("o_orderdate")).alias("read_at"), F.col("o_orderpriority").alias("hit"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("page"), F.col("ts").alias("at"), F.col("event_type").alias("outcome"), F.col("value").alias("seconds"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.folder_tree(spark, table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))


FOLDERS = """folders_t(id, parent, name) AS (SELECT 0, NULL, 'all' UNION ALL SELECT r_regionkey + 1, 0, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation)"""


@query("e1_list_pages", f"WITH {PAGES}, {CHANGES} SELECT id, name FROM pages_t WHERE status = 'ok' AND unread AND contains(lower(name), '#00000') AND kind = 'BUILDING' AND errors >= 2 AND id IN (SELECT page FROM changes_t WHERE hit = '1-URGENT')")
def e1_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = H.list_filters(status="ok", unread=True, text="#00000", kind="BUILDING", min_errors=2)
    return H.list_pages(pages(spark, sf_dir), filters, changes(spark, sf_dir).where("hit = '1-URGENT'")).select("id", "name")


@query("e2_page_after", f"WITH {PAGES} SELECT id, name, balance FROM pages_t WHERE balance < 4000 OR (balance = 4000 AND id < 50) ORDER BY balance DESC, id DESC LIMIT 50")
def e2_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty after a cursor, by balance downwards."""
    return H.page_after(pages(spark, sf_dir), "balance", True, (4000.0, 50), 50).select("id", "name", "balance")


@query("e3_subtree", f"""WITH RECURSIVE {FOLDERS}, t(id, depth) AS (SELECT id, 0 FROM folders_t WHERE id = 2 UNION ALL SELECT f.id, t.depth + 1 FROM t JOIN folders_t f ON f.parent = t.id)
SELECT c_custkey AS page, t.id AS folder, t.depth FROM t JOIN customer ON c_nationkey + 100 = t.id""")
def e3_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below one folder of the tree."""
    t = H.subtree(folders(spark, sf_dir), 2)
    c = table(spark, sf_dir, "customer")
    return c.join(t, F.col("c_nationkey") + 100 == F.col("id")).select(F.col("c_custkey").alias("page"), F.col("id").alias("folder"), "depth")


@query("e4_folder_paths", f"""WITH RECURSIVE {FOLDERS}, t(id, path) AS (SELECT id, name FROM folders_t WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM t JOIN folders_t f ON f.parent = t.id)
SELECT s_suppkey AS page, path FROM t JOIN supplier ON s_nationkey + 100 = id""")
def e4_folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's folder names from the root."""
    t = H.folder_paths(folders(spark, sf_dir))
    return table(spark, sf_dir, "supplier").join(t, F.col("s_nationkey") + 100 == F.col("id")).select(F.col("s_suppkey").alias("page"), "path")


@query("e5_narrow", f"WITH {PAGES} SELECT id FROM pages_t WHERE unread AND kind = 'MACHINERY' AND folder IN (1, 2, 3, 5, 8, 13, 21) AND errors >= 3")
def e5_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved search and what is asked on top of it."""
    return pages(spark, sf_dir).where(H.narrow(H.list_filters(unread=True, kind="MACHINERY"), H.list_filters(folders=[1, 2, 3, 5, 8, 13, 21], min_errors=3))).select("id")


@query("e6_search_counts", f"""WITH {PAGES} SELECT 'errors' AS search, count(*) FILTER (status = 'error') AS total, count(*) FILTER (status = 'error' AND unread) AS unread FROM pages_t
UNION ALL SELECT 'cars', count(*) FILTER (kind = 'AUTOMOBILE'), count(*) FILTER (kind = 'AUTOMOBILE' AND unread) FROM pages_t UNION ALL SELECT 'flaky', count(*) FILTER (errors >= 4), count(*) FILTER (errors >= 4 AND unread) FROM pages_t""")
def e6_search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search_counts(pages(spark, sf_dir), {"errors": H.list_filters(status="error"), "cars": H.list_filters(kind="AUTOMOBILE"), "flaky": H.list_filters(min_errors=4)})


@query("e7_page_counts", f"WITH {PAGES} SELECT folder, count(*) AS total, count(*) FILTER (unread) AS unread FROM pages_t GROUP BY ROLLUP (folder)")
def e7_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page_counts(pages(spark, sf_dir))


@query("e8_unread_hits", f"""WITH {CHANGES}, h AS (SELECT page, hit, max(moment) AS moment FROM changes_t WHERE is_unread GROUP BY ALL) SELECT page, string_agg(hit, ',' ORDER BY moment DESC, hit DESC) AS hits FROM h GROUP BY page""")
def e8_unread_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).where("is_unread").withColumn("hits", F.array("hit"))
    return H.unread_hits(rows, "page", "hits", "at").withColumn("hits", F.array_join("hits", ","))


@query("e9_report_changed", f"WITH {PAGES}, {CHANGES} SELECT change, page, name, moment, (SELECT max(moment) FROM changes_t WHERE moment > TIMESTAMP '1998-01-01') AS next_marker FROM changes_t JOIN pages_t ON page = id WHERE moment > TIMESTAMP '1998-01-01'")
def e9_report_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.report_changed(changes(spark, sf_dir), pages(spark, sf_dir), F.lit(SINCE))
    return found.withColumn("moment", F.col("at").cast("timestamp_ntz")).drop("at").withColumn("next_marker", F.col("next_marker").cast("timestamp_ntz"))


@query("e10_report_errors", f"""WITH {PAGES}, {RUNS}, l AS (SELECT page, CAST(max_by(seconds, run) AS VARCHAR) AS reason FROM runs_t WHERE outcome = 'error' GROUP BY page)
SELECT id, name, status, errors, coalesce(reason, status) AS reason FROM pages_t LEFT JOIN l ON page = id WHERE status IN ('error', 'needs_login') OR errors > 0""")
def e10_report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in error with the value of their last failing run."""
    return H.report_errors(pages(spark, sf_dir), runs(spark, sf_dir).withColumn("reason", F.col("seconds").cast("string")), F.col("outcome") == "error")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).where("is_unread and hit = '5-LOW'").select("page", F.col("change").cast("string").alias("message"), "at")


_PROBLEMS = f"""WITH {PAGES}, {RUNS}, {CHANGES}, l AS (SELECT page, CAST(max_by(seconds, run) AS VARCHAR) AS reason, max_by(moment, run) AS moment FROM runs_t WHERE outcome = 'error' GROUP BY page),
a AS (SELECT 'page_error' AS kind, id, coalesce(reason, 'unknown error') AS message, moment FROM pages_t LEFT JOIN l ON page = id WHERE status = 'error'
  UNION ALL SELECT 'action_failed', page, CAST(change AS VARCHAR), moment FROM changes_t JOIN pages_t ON page = id WHERE is_unread AND hit = '5-LOW')"""


@query("e11_problems", _PROBLEMS + " SELECT * FROM a ORDER BY moment DESC NULLS LAST, id DESC, kind, message LIMIT 100")
def e11_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing pages with their last failing run, and failed actions of unread changes, newest first."""
    found, _ = H.problems(pages(spark, sf_dir), runs(spark, sf_dir).withColumn("reason", F.col("seconds").cast("string")), F.col("outcome") == "error", _actions(spark, sf_dir), 100)
    return found.select("kind", "id", "message", F.col("at").cast("timestamp_ntz").alias("moment"))


@query("e11_total", _PROBLEMS + " SELECT count(*) AS total FROM a")
def e11_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many problems there are in all."""
    return H.problems(pages(spark, sf_dir), runs(spark, sf_dir).withColumn("reason", F.col("seconds").cast("string")), F.col("outcome") == "error", _actions(spark, sf_dir), 100)[1]


_STATES = """st AS (SELECT o_custkey AS page, max(o_orderkey) AS latest, min(o_orderkey) AS baseline FROM orders GROUP BY 1),
pg AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'error' ELSE 'ok' END AS status, c_custkey % 4 = 0 AS unread, CAST(c_custkey % 6 AS INTEGER) AS errors, latest, baseline FROM customer LEFT JOIN st ON page = c_custkey)"""


@query("e21_mark_pages_read", f"""WITH {_STATES} SELECT id, CASE WHEN NOT r THEN status WHEN status = 'changed' THEN 'ok' WHEN status = 'error' THEN CASE WHEN latest IS NULL THEN 'new' ELSE 'ok' END ELSE status END AS status, unread AND NOT r AS unread,
CASE WHEN r THEN 0 ELSE errors END AS errors, latest, CASE WHEN r THEN latest ELSE baseline END AS baseline, CASE WHEN r THEN latest ELSE baseline END AS anchor, r AND (unread OR baseline IS DISTINCT FROM latest) AS was_unread FROM (SELECT *, id % 5 < 2 AS r FROM pg)""")
def e21_mark_pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of five customers read, orders as versions: pointers, status and counts of all pages."""
    key = F.col("c_custkey")
    versions = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.max("o_orderkey").alias("latest"), F.min("o_orderkey").alias("baseline"))
    status = F.when(key % 3 == 0, "changed").when(key % 3 == 1, "error").otherwise("ok")
    own = table(spark, sf_dir, "customer").select(key.alias("id"), status.alias("status"), (key % 4 == 0).alias("unread"), (key % 6).cast("int").alias("errors"))
    own = own.join(versions, own["id"] == versions["page"], "left").drop("page").withColumn("anchor", F.col("baseline"))
    return H.mark_pages_read(own, own.where("id % 5 < 2").select(F.col("id").alias("page"))).select("id", "status", "unread", "errors", "latest", "baseline", "anchor", "was_unread")


@query("e12_latest_failing_run", f"WITH {RUNS} SELECT page, max_by(seconds, run) AS seconds, max(run) AS run FROM runs_t WHERE outcome = 'error' GROUP BY page")
def e12_latest_failing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_per(runs(spark, sf_dir).where("outcome = 'error'"), "page", "run", "seconds")


@query("e13_newest_runs", f"WITH {RUNS} SELECT page, run, outcome, row_number() OVER (PARTITION BY page ORDER BY run DESC) AS nth FROM runs_t WHERE run < 9000 QUALIFY nth <= 5")
def e13_newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.newest(runs(spark, sf_dir), "page", "run", 5, 9000).select("page", "run", "outcome", F.col("nth").cast("long"))


@query("e14_check_times", f"WITH {RUNS} SELECT CASE WHEN outcome IN ('click', 'view') THEN 'browser' ELSE 'http' END AS pool, count(*) AS n, round(avg(seconds), 6) AS mean_s FROM runs_t WHERE moment >= TIMESTAMP '2024-01-10' AND outcome <> 'signup' GROUP BY 1")
def e14_check_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).where((F.col("at") >= F.lit(dt.datetime(2024, 1, 10))) & (F.col("outcome") != "signup"))
    pool = F.when(F.col("outcome").isin("click", "view"), "browser").otherwise("http")
    return rows.groupBy(pool.alias("pool")).agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean_s"))


@query("e19_error_streaks", f"""WITH {RUNS}, g AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY moment, run) AS island FROM runs_t),
s AS (SELECT run, page, CASE WHEN outcome = 'error' THEN greatest(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY page, island ORDER BY moment, run) - 1, 0) ELSE 0 END AS streak FROM g)
SELECT run, page, CAST(streak AS INTEGER) AS streak, CASE WHEN streak >= 3 THEN 'error' WHEN streak > 0 THEN 'warning' ELSE 'ok' END AS status FROM s""")
def e19_error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.error_streaks(runs(spark, sf_dir), "page", ["at", "run"], F.col("outcome") == "error").select("run", "page", "streak", "status")


@query("e20_pointers", """WITH v AS (SELECT user_id AS page, event_id AS version, ts AS moment FROM events WHERE event_type IN ('view', 'purchase')),
r AS (SELECT user_id AS page, max(ts) AS read_at FROM events WHERE event_type = 'click' GROUP BY 1), a AS (SELECT user_id AS page, max(ts) AS alert_at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT v.page, max_by(version, moment) AS latest, max_by(version, moment) FILTER (moment <= read_at) AS baseline, max_by(version, moment) FILTER (moment <= greatest(read_at, alert_at)) AS anchor
FROM v LEFT JOIN r ON v.page = r.page LEFT JOIN a ON v.page = a.page GROUP BY v.page""")
def e20_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(spark, sf_dir)
    return H.pointers(e.where("outcome in ('view', 'purchase')").select("page", "at", F.col("run").alias("version")), e.where("outcome = 'click'"), e.where("outcome = 'signup'"))


@query("e21_mark_read", f"WITH {PAGES}, {CHANGES} SELECT change, CASE WHEN read_at IS NULL AND page IN (SELECT id FROM pages_t WHERE unread) THEN TIMESTAMP '2024-01-31' ELSE read_at END AS read_at FROM changes_t")
def e21_mark_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pages(spark, sf_dir).where("unread").select(F.col("id").alias("page"))
    return H.mark_read(changes(spark, sf_dir), ids, NOW).select("change", F.col("read_at").cast("timestamp_ntz").alias("read_at"))


@query("e22_prune_versions", f"""WITH {CHANGES}, n AS (SELECT change AS version, page, row_number() OVER (PARTITION BY page ORDER BY moment DESC, change DESC) AS nth FROM changes_t)
SELECT page, version FROM n WHERE nth > 5 AND version NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def e22_prune_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders beyond the newest five of a customer, but for those that certain line items pin."""
    versions = changes(spark, sf_dir).select("page", "at", F.col("change").alias("version"))
    pinned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("version"))
    return retention.prune_versions(versions, pinned, 5).select("page", "version")


@query("e23_unreferenced", "SELECT p_partkey AS content FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def e23_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line item and no supplier key refers to, older than the grace size."""
    content = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content"), (-F.col("p_size")).alias("stored_at"))
    li = table(spark, sf_dir, "lineitem")
    refs = [li.where("l_quantity > 40").select(F.col("l_partkey").alias("content")), li.select(F.col("l_suppkey").alias("content"))]
    return retention.unreferenced(content, refs, -5).select("content")


@query("e24_cap_candidates", """WITH v AS (SELECT o_orderkey AS version, o_custkey AS content, o_orderdate AS moment, CAST(o_totalprice AS BIGINT) % 1000 AS b FROM orders),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY content ORDER BY moment, version) = 1 THEN b ELSE 0 END AS fresh FROM v),
r AS (SELECT *, sum(fresh) OVER (ORDER BY moment, version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f)
SELECT version, content, CAST(fresh AS BIGINT) AS fresh FROM r WHERE run - fresh < 200000""")
def e24_cap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("content"), F.col("o_orderdate").alias("at"), (F.rint("o_totalprice").cast("long") % 1000).alias("bytes"))
    return retention.cap_candidates(v, 200_000).select("version", "content", F.col("fresh").cast("long").alias("fresh"))


@query("e25_purge", f"WITH {RUNS} SELECT run, page FROM runs_t WHERE moment >= TIMESTAMP '2024-01-24'")
def e25_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.purge(runs(spark, sf_dir), "at", F.lit(NOW - dt.timedelta(days=7))).select("run", "page")


@query("e26_stale_pages", f"""WITH {RUNS}, s AS (SELECT *, max(CASE WHEN outcome = 'purchase' THEN moment END) OVER (PARTITION BY page ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM runs_t)
SELECT page, since, min(moment) AS alert_at FROM s WHERE moment >= since + INTERVAL 3 DAY GROUP BY ALL""")
def e26_stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.stale_pages(runs(spark, sf_dir), "page", "at", F.col("outcome") == "purchase", 3)
    return found.select("page", F.col("since").cast("timestamp_ntz").alias("since"), F.col("alert_at").cast("timestamp_ntz").alias("alert_at"))


@query("e27_resolve_config", """WITH c AS (SELECT c_custkey AS page, 0 AS depth, 'interval' AS path, '3600' AS value FROM customer UNION ALL SELECT c_custkey, 0, 'min_words', '0' FROM customer
UNION ALL SELECT c_custkey, 1, 'interval', CASE WHEN c_nationkey % 2 = 0 THEN '900' ELSE '1800' END FROM customer WHERE c_nationkey % 5 <> 0
UNION ALL SELECT c_custkey, 2, 'min_words', CASE WHEN c_acctbal < 0 THEN NULL ELSE '25' END FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT page, path, value FROM (SELECT page, path, value FROM c QUALIFY row_number() OVER (PARTITION BY page, path ORDER BY depth DESC) = 1) WHERE value IS NOT NULL""")
def e27_resolve_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults, folder settings and page settings of every customer; a null on the page removes one."""
    c = table(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("page"), F.lit(0).alias("depth"), F.explode(F.create_map(F.lit("interval"), F.lit("3600"), F.lit("min_words"), F.lit("0"))).alias("path", "value"))
    folder = c.where("c_nationkey % 5 <> 0").select(F.col("c_custkey").alias("page"), F.lit(1).alias("depth"), F.lit("interval").alias("path"), F.when(F.col("c_nationkey") % 2 == 0, "900").otherwise("1800").alias("value"))
    own = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("page"), F.lit(2).alias("depth"), F.lit("min_words").alias("path"), F.when(F.col("c_acctbal") >= 0, "25").alias("value"))
    return H.resolve_config(base.unionByName(folder).unionByName(own), "page")


@query("e28_dedupe_import", """WITH n AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS k, url FROM pages),
x AS (SELECT page_id, url, k, row_number() OVER (PARTITION BY k ORDER BY page_id) AS nth, k IN (SELECT k FROM n WHERE contains(url, '.org')) AS known FROM n)
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'error' WHEN known OR nth > 1 THEN 'skipped' ELSE 'created' END AS outcome FROM x""")
def e28_dedupe_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page addresses as an import into a list that has those of one domain."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return H.dedupe_import(p, p.where(F.col("url").contains(".org")), "page_id").select("page_id", "outcome")


@query("e33_outcome_counts", f"WITH {RUNS} SELECT outcome, count(*) AS n FROM runs_t WHERE moment >= TIMESTAMP '2024-01-30' AND moment < TIMESTAMP '2024-01-31' GROUP BY outcome")
def e33_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).where((F.col("at") >= F.lit(NOW - dt.timedelta(days=1))) & (F.col("at") < F.lit(NOW)))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query("a13_export_watchlist", f"""WITH RECURSIVE {FOLDERS}, t(id, path) AS (SELECT id, name FROM folders_t WHERE parent IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM t JOIN folders_t f ON f.parent = t.id), {PAGES}
SELECT p.id, p.name, url, path AS folder_path, CASE WHEN folder % 2 = 0 THEN '15m' ELSE '1h' END AS interval_text FROM pages_t p JOIN t ON folder + 100 = t.id""")
def a13_export_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its folder path and effective interval."""
    from chronodiff.functions.text import fmt_interval

    p, t = pages(spark, sf_dir), H.folder_paths(folders(spark, sf_dir)).withColumnRenamed("id", "fid")
    seconds = F.when(F.col("folder") % 2 == 0, F.lit(900)).otherwise(F.lit(3600))
    return p.join(t, F.col("folder") + 100 == F.col("fid")).select("id", "name", "url", F.col("path").alias("folder_path"), fmt_interval(seconds).alias("interval_text"))


@query("a12_import_rows", """SELECT c_custkey AS customer, CASE WHEN c_custkey % 9 = 0 THEN 'no address' WHEN c_custkey % 7 = 0 THEN 'bad address' WHEN c_custkey % 11 = 0 THEN 'bad interval' END AS problem,
CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CASE c_custkey % 3 WHEN 0 THEN 900 WHEN 1 THEN 7200 ELSE 60 END END AS interval_s, c_mktsegment || '/' || c_nationkey AS folder, CASE WHEN c_custkey % 2 = 0 THEN 'sale' || chr(10) || 'stock' END AS keywords FROM customer""")
def a12_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the table of a watch list: every row read, faulty ones with their problem."""
    key = F.col("c_custkey")
    url = F.when(key % 9 == 0, " ").when(key % 7 == 0, F.concat(F.lit("example "), key.cast("string"))).otherwise(F.concat(F.lit(" https://example.com/"), key.cast("string")))
    text = F.when(key % 11 == 0, "soon").when(key % 3 == 0, "15m").when(key % 3 == 1, "2h").otherwise("30s")
    folder = F.concat(F.lit(" "), "c_mktsegment", F.lit(" / /"), F.col("c_nationkey").cast("string"))
    words = F.when(key % 2 == 0, "sale\r\nstock").otherwise(" ")
    rows = WL.table_rows(table(spark, sf_dir, "customer").select(key.alias("customer"), url.alias("URL"), F.col("c_name").alias("Name"), folder.alias("Folder "), text.alias("inter val"), words.alias("keywords")))
    return WL.import_rows(rows).select("customer", "problem", F.col("interval_s").cast("int").alias("interval_s"), "folder", "keywords")


@query("a12_bookmark_files", """SELECT n_nationkey AS file, c_custkey // 1000 AS part, CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS row,
'https://example.com/?a=1&id=' || c_custkey AS url, c_name || ' & co' AS name, n_name || '/' || c_mktsegment AS folder FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def a12_bookmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as links in bookmark files, a file for each nation and thousand, a folder in a folder for each segment, read back."""
    key = F.col("c_custkey")
    link = F.concat(F.lit('<DT><A ADD_DATE="1" HREF="https://example.com/?a=1&amp;id='), key.cast("string"), F.lit('">'), F.col("c_name"), F.lit(" &amp; <b>co</b></A>\n"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.struct(F.col("n_nationkey").alias("file"), F.expr("c_custkey div 1000").alias("part")).alias("f"), "n_name", "c_mktsegment", "c_custkey", link.alias("link"))
    lists = rows.groupBy("f", "n_name", "c_mktsegment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "link"))), lambda x: x["link"]), "").alias("links"))
    inner = F.concat(F.lit("<DT><H3>"), "c_mktsegment", F.lit("</H3>\n<DL><p>\n"), "links", F.lit("</DL><p>\n"))
    files = lists.groupBy("f", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", inner.alias("x")))), lambda x: x["x"]), "").alias("body"))
    html = F.concat(F.lit("<H1>Bookmarks</H1>\n<DL><p>\n<DT><H3 FOLDED>"), "n_name", F.lit("</H3>\n<DL><p>\n"), "body", F.lit("</DL><p>\n</DL><p>"))
    found = WL.bookmark_rows(files.select("f", html.alias("html")), "f", "html")
    return found.select("file.file", "file.part", "row", "url", "name", "folder")


@query("a13_export_json", f"""WITH {FOLDERS}, {PAGES} SELECT 'folder' AS kind, CAST(id AS VARCHAR) AS id, id AS n, name FROM folders_t UNION ALL SELECT 'page', CAST(id AS VARCHAR), id, name FROM pages_t""")
def a13_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch list as JSON lines, read back."""
    p = pages(spark, sf_dir).select("id", "name", "url", "folder", F.lit(900).alias("interval_s"), F.lit("sale").alias("keywords"))
    found = WL.export_json(p, folders(spark, sf_dir))
    return found.select("kind", "id", F.get_json_object("json", "$.id").cast("long").alias("n"), F.get_json_object("json", "$.name").alias("name"))


#: All columns that lists filter and sort by.
FULL = """full_t AS (SELECT p.*, id % 13 <> 0 AS enabled, CASE WHEN id % 2 = 0 THEN 'static' ELSE 'browser' END AS method, CASE WHEN id % 17 = 0 THEN 'pdf' END AS plugin,
  CASE WHEN id % 29 <> 0 THEN TIMESTAMP '1998-01-01' + to_days(CAST(id * 37 % 1000 AS INTEGER)) END AS last_changed, TIMESTAMP '1998-01-01' + to_days(CAST(id * 11 % 900 AS INTEGER)) AS last_checked,
  CASE WHEN id % 31 <> 0 THEN TIMESTAMP '2000-01-01' + to_days(CAST(id * 7 % 100 AS INTEGER)) END AS next_due FROM pages_t p)"""
_ORDERS = {"id": ("id", "500"), "name": ("lower(name)", "'customer#000000500'"), "url": ("lower(url)", "'https://host15.example.com/500'"), "status": ("status", "'error'"), "errors": ("errors", "3"),
           "last_changed": ("coalesce(last_changed, TIMESTAMP '0001-01-01')", "TIMESTAMP '1999-01-01'"), "last_checked": ("last_checked", "TIMESTAMP '1999-01-01'"), "next_due": ("coalesce(next_due, TIMESTAMP '0001-01-01')", "TIMESTAMP '2000-02-01'")}


def full_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def day(start: str, factor: int, span: int):  # noqa: ANN202
        return F.date_add(F.lit(start).cast("date"), (F.col("id") * factor % span).cast("int")).cast("timestamp")

    return pages(spark, sf_dir).withColumns({
        "enabled": F.col("id") % 13 != 0, "method": F.when(F.col("id") % 2 == 0, "static").otherwise("browser"), "plugin": F.when(F.col("id") % 17 == 0, "pdf"),
        "last_changed": F.when(F.col("id") % 29 != 0, day("1998-01-01", 37, 1000)), "last_checked": day("1998-01-01", 11, 900), "next_due": F.when(F.col("id") % 31 != 0, day("2000-01-01", 7, 100)),
    })


_FILTERED = "status = 'ok' AND unread AND enabled AND method = 'static' AND contains(lower(name), '#0') AND contains(lower(url), 'host1') AND last_changed >= TIMESTAMP '1998-06-01' AND id IN (SELECT page FROM changes_t WHERE is_unread AND hit IS NOT NULL)"


def _filtered(spark: SparkSession, sf_dir: str) -> tuple:
    start = H.later_start(dt.datetime(1998, 6, 1), dt.datetime(1998, 3, 1))
    found = H.list_filters(status="ok", unread=True, enabled=True, method="static", text="#0", more_text="HOST1", changed_since=start)
    return full_pages(spark, sf_dir), found, changes(spark, sf_dir).where("is_unread and hit is not null")


@query("e1_all_filters", f"WITH {PAGES}, {CHANGES}, {FULL} SELECT id, url FROM full_t WHERE {_FILTERED}")
def e1_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in name and address, switches, method, start of changes, unread hits."""
    return H.list_pages(*_filtered(spark, sf_dir)).select("id", "url")


@query("e1_total", f"WITH {PAGES}, {CHANGES}, {FULL} SELECT count(*) AS total FROM full_t WHERE {_FILTERED}")
def e1_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.list_total(*_filtered(spark, sf_dir))


@query("e1_plugin", f"WITH {PAGES}, {FULL} SELECT id FROM full_t WHERE plugin = 'pdf' AND NOT enabled")
def e1_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.list_pages(full_pages(spark, sf_dir), H.list_filters(plugin="pdf", enabled=False)).select("id")


@query("e2_all_orders", f"WITH {PAGES}, {FULL} " + " UNION ALL ".join(
    f"(SELECT '{n}' AS sort, id FROM full_t WHERE {x} > {v} OR ({x} = {v} AND id > 40) ORDER BY {x}, id LIMIT 25)" for n, (x, v) in _ORDERS.items()))
def e2_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of twenty-five after a cursor in each of the eight orders."""
    p, out = full_pages(spark, sf_dir), None
    cursors = {"id": 500, "name": "customer#000000500", "url": "https://host15.example.com/500", "status": "error", "errors": 3, "last_changed": dt.datetime(1999, 1, 1), "last_checked": dt.datetime(1999, 1, 1), "next_due": dt.datetime(2000, 2, 1)}
    for sort, value in cursors.items():
        got = H.page_after(p, sort, False, (value, 40), 25).select(F.lit(sort).alias("sort"), "id")
        out = got if out is None else out.unionByName(got)
    return out


@query("e7_recent_counts", f"""WITH {CHANGES} SELECT count(DISTINCT page) FILTER (is_unread AND hit IS NOT NULL) AS unread_hit_pages,
count(DISTINCT page) FILTER (moment > TIMESTAMP '1997-06-01' - INTERVAL 24 HOUR AND moment <= TIMESTAMP '1997-06-01') AS changed_day FROM changes_t""")
def e7_recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.recent_counts(changes(spark, sf_dir), dt.datetime(1997, 6, 1))


@query("e10_report_all", f"""WITH {PAGES}, {CHANGES}, l AS (SELECT page, max(moment) AS last_change, count(*) FILTER (is_unread) AS n FROM changes_t GROUP BY page)
SELECT id, name, status, last_change, coalesce(n, 0) AS unread_changes FROM pages_t LEFT JOIN l ON id = page""")
def e10_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.report_all(pages(spark, sf_dir), changes(spark, sf_dir))


@query("e11_report_errors", f"""WITH {PAGES}, {RUNS}, l AS (SELECT page, arg_max(moment, (moment, run)) AS "at", arg_max(outcome, (moment, run)) AS outcome, count(*) FILTER (outcome = 'error') AS failures FROM runs_t GROUP BY page)
SELECT id, name, "at", outcome, failures FROM pages_t JOIN l ON id = page WHERE outcome = 'error'""")
def e11_report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for the watched pages of the users' runs."""
    return H.newest_failures(pages(spark, sf_dir), runs(spark, sf_dir), F.col("outcome") == "error")


@query("d17_verdict_hooks", f"""WITH {CHANGES}, c AS (SELECT change, hit, change % 5 AS k, CASE WHEN change % 3 = 0 THEN 'below_threshold' END AS reason, year(moment) AS y FROM changes_t WHERE page % 7 <> 0)
SELECT change, CASE WHEN k = 0 THEN true WHEN y < 1994 THEN false END AS forced, CASE WHEN k = 0 THEN NULL WHEN y < 1994 THEN 'old' ELSE reason END AS reason,
       array_to_string(list_distinct(CASE WHEN hit IS NULL THEN [] ELSE [hit] END || CASE WHEN y = 1996 THEN ['leap'] ELSE [] END), ',') AS hits FROM c""".replace("list_distinct(", "("))
def d17_verdict_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdict hooks, a keyword hook and a skip condition on all changes."""
    year = F.year("at")
    hooks = K.Hooks(skip=(F.col("page") % 7 == 0,), compare=(("always", F.when(F.col("change") % 5 == 0, True)), ("old", F.when(year < 1994, False))), keywords=(F.when(year == 1996, F.array(F.lit("leap"))),))
    rows = K.checked(changes(spark, sf_dir), hooks).withColumn("reason", F.when(F.col("change") % 3 == 0, "below_threshold"))
    rows = rows.withColumn("hits", F.when(F.col("hit").isNotNull(), F.array("hit")))
    return K.with_verdict(K.with_keyword_hits(rows, hooks), hooks).select("change", "forced", "reason", F.array_join("hits", ",").alias("hits"))


@query("h5_latest_state", """SELECT user_id, event_type AS name, max(event_id) AS newest, arg_max(value, event_id) AS value FROM events GROUP BY ALL HAVING arg_max(value, event_id) IS NOT NULL""")
def h5_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hook last noted for each user and kind of event."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.struct("event_id", "value").alias("value"), "event_id")
    return K.latest_state(e, ["user_id"], "event_id").select("user_id", "name", F.col("value.event_id").alias("newest"), F.col("value.value").alias("value"))
