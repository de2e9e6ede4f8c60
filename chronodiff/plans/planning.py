"""Queries on load, schedules, links and pictures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.operators import capacity as C
from chronodiff.operators import crawl, raster
from chronodiff.plans.registry import query
from chronodiff.plans.texts import LINKS, page_links
from chronodiff.session import shared_folder, table

NOW = dt.datetime(2024, 1, 15, 12, 0)

_LOAD = """load_t AS (SELECT p_partkey AS page, 'host' || p_partkey % 40 AS host, CASE WHEN p_size > 25 THEN 'http' ELSE 'browser' END AS pool, CASE p_partkey % 4 WHEN 0 THEN 'interval' WHEN 1 THEN 'adaptive' WHEN 2 THEN 'times' ELSE 'manual' END AS mode,
 CASE WHEN p_partkey % 4 < 2 THEN 1.0 / greatest(p_size * 30, 60) WHEN p_partkey % 4 = 2 THEN (p_size % 5) * 7 / 604800.0 ELSE 0.0 END AS demand FROM part)"""


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with a schedule."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    mode = F.when(k % 4 == 0, "interval").when(k % 4 == 1, "adaptive").when(k % 4 == 2, "times").otherwise("manual")
    rate = C.demand(mode, F.col("p_size") * 30, F.col("p_size") % 5, F.lit(7))
    return p.select(k.alias("page"), F.concat(F.lit("host"), (k % 40).cast("string")).alias("host"), F.when(F.col("p_size") > 25, "http").otherwise("browser").alias("pool"), mode.alias("mode"), rate.alias("demand"))


@query("e15_demand", f"WITH {_LOAD} SELECT page, mode, round(demand, 9) AS demand FROM load_t")
def e15_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).select("page", "mode", F.round("demand", 9).alias("demand"))


@query("e16_capacity", f"""WITH {_LOAD}, d AS (SELECT pool, sum(demand) AS demand FROM load_t GROUP BY pool),
m AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browser' ELSE 'http' END AS pool, CASE WHEN count(*) >= 5 THEN avg(value) END AS mean_s FROM events GROUP BY 1)
SELECT d.pool, round(demand, 6) AS demand, round(mean_s, 6) AS mean_s, round(CASE d.pool WHEN 'http' THEN 400 ELSE 3 END / mean_s, 6) AS capacity, round(demand * mean_s / CASE d.pool WHEN 'http' THEN 400 ELSE 3 END, 6) AS utilisation,
 coalesce(demand * mean_s / CASE d.pool WHEN 'http' THEN 400 ELSE 3 END > 0.800001, false) AS warn FROM d LEFT JOIN m USING (pool)""")
def e16_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("click", "view"), "browser").otherwise("http").alias("pool"), F.col("value").alias("seconds"))
    found = C.capacity(load(spark, sf_dir), runs, {"http": 400, "browser": 3})
    return found.select("pool", *[F.round(c, 6).alias(c) for c in ("demand", "mean_s", "capacity", "utilisation")], "warn")


@query("e17_host_stretch", f"""WITH {_LOAD}, d AS (SELECT host, sum(demand) AS demand FROM load_t GROUP BY host)
SELECT host, round(demand, 6) AS demand, CASE WHEN host IN ('host1', 'host5') THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS "limit", round(greatest(1.0, demand / CASE WHEN host IN ('host1', 'host5') THEN 0.01 ELSE 0.05 END), 6) AS factor FROM d""")
def e17_host_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("host1", 0.01), ("host5", 0.01)], "host string, limit double")
    return C.host_stretch(load(spark, sf_dir), own, 0.05).select("host", F.round("demand", 6).alias("demand"), "limit", F.round("factor", 6).alias("factor"))


@query("e16_host_capacity", f"""WITH {_LOAD}, d AS (SELECT host, count(*) AS pages, sum(demand) AS demand, CASE WHEN host IN ('host1', 'host5') THEN 0.01::DOUBLE ELSE 0.05::DOUBLE END AS "limit" FROM load_t GROUP BY host)
SELECT host, pages, round(demand, 6) AS demand, "limit", round(demand / "limit", 6) AS utilisation, round(greatest(1.0, demand / "limit"), 6) AS factor, demand / "limit" > 1.000001 AS over_limit FROM d ORDER BY demand / "limit" DESC, d.demand DESC, host DESC LIMIT 50""")
def e16_host_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("host1", 0.01), ("host5", 0.01)], "host string, limit double")
    found = C.host_capacity(load(spark, sf_dir), own, 0.05)
    return found.select("host", "pages", F.round("demand", 6).alias("demand"), "limit", F.round("utilisation", 6).alias("utilisation"), F.round("factor", 6).alias("factor"), "over_limit")


@query("e18_host_gaps", """WITH r AS (SELECT user_id AS host, ts AS s, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS e FROM events),
g AS (SELECT host, epoch_us(s) - lag(epoch_us(s)) OVER (PARTITION BY host ORDER BY s) AS gap FROM r), gm AS (SELECT host, min(gap) / 1e6 AS min_gap_s FROM g GROUP BY host),
v AS (SELECT host, s AS t, 1 AS d FROM r UNION ALL SELECT host, e, -1 FROM r), l AS (SELECT host, sum(d) OVER (PARTITION BY host ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS level FROM v)
SELECT host, min_gap_s, CAST(max(level) AS BIGINT) AS peak FROM l JOIN gm USING (host) GROUP BY ALL""")
def e18_host_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hosts, events as runs that last their value in minutes."""
    ends = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("long"))
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("s"), ends.alias("e"))
    return C.host_gaps(runs, "host", "s", "e").select("host", "min_gap_s", F.col("peak").cast("long"))


@query("e32_metric_rollup", """SELECT event_type AS name, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high, round((max_by(value, ts) - min_by(value, ts)) / nullif(min_by(value, ts), 0) * 100, 6) AS growth FROM events GROUP BY 1, 2""")
def e32_metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.metric_rollup(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return found.select(F.col("event_type").alias("name"), F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "high", F.round("growth", 6).alias("growth"))


_DUE = """due_t AS (SELECT event_id AS page, ts AS last, CAST(value * 1000 AS BIGINT) % 86400 AS interval_s, event_id % 3 AS priority FROM events)"""


@query("f1_next_due", """SELECT event_id AS page, ts + to_seconds(CAST(ceil(greatest(CAST(round(value * 1000) AS BIGINT) % 86400, 60) * 1.5) AS BIGINT)) AS due FROM events""")
def f1_next_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a page's last check: the next one, stretched by half."""
    e = table(spark, sf_dir, "events")
    interval = F.round(F.col("value") * 1000).cast("long") % 86400
    return e.select(F.col("event_id").alias("page"), C.next_interval_due(F.col("ts"), interval, F.lit(1.5)).cast("timestamp_ntz").alias("due"))


@query("f2_next_clock_time", """WITH c AS (SELECT event_id, ts, d, t FROM events, range(9) a(d), (VALUES (390), (1110)) b(t)),
m AS (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(d AS INTEGER)) + to_minutes(t) AS x FROM c)
SELECT event_id AS page, min(x) AS due FROM m WHERE x > ts AND isodow(x) IN (1, 3, 6) GROUP BY 1""")
def f2_next_clock_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """06:30 and 18:30 on Mondays, Wednesdays and Saturdays after each event."""
    times, days = F.array(F.lit(390), F.lit(1110)), F.array(F.lit(0), F.lit(2), F.lit(5))
    due = C.next_clock_time(F.col("ts").cast("timestamp"), times, days)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), due.cast("timestamp_ntz").alias("due"))


#: Even events may run from 22:00 to 06:00, odd ones on work days from 09:00 to 17:00; ``t0`` is the time to be moved.
_LIMITS = """lim AS (SELECT *, epoch_us(t0) % 86400000000 / 60000000.0 AS m, date_trunc('day', t0) AS d, CASE WHEN event_id % 2 = 0 THEN 1320 ELSE 540 END AS opens, event_id % 2 = 0 OR isodow(t0) < 6 AS day_ok FROM wanted),
nxt AS (SELECT event_id, min(d + to_days(CAST(k AS INTEGER)) + to_minutes(opens)) AS later FROM lim, range(9) t(k) WHERE (k > 0 OR m < opens) AND (event_id % 2 = 0 OR isodow(d + to_days(CAST(k AS INTEGER))) < 6) GROUP BY event_id),
moved AS (SELECT event_id, CASE WHEN day_ok AND CASE WHEN event_id % 2 = 0 THEN m >= 1320 OR m <= 360 ELSE m BETWEEN 540 AND 1020 END THEN t0 ELSE later END AS due FROM lim LEFT JOIN nxt USING (event_id))"""


def limits() -> tuple:
    """Start, end and days that events may run."""
    wraps = F.col("event_id") % 2 == 0
    days = F.when(wraps, F.array().cast("array<int>")).otherwise(F.array(*[F.lit(d) for d in range(5)]))
    return F.when(wraps, 1320).otherwise(540), F.when(wraps, 360).otherwise(1020), days


@query("f3_apply_limits", f"WITH wanted AS (SELECT event_id, ts AS t0 FROM events), {_LIMITS} SELECT event_id AS page, due FROM moved")
def f3_apply_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event moved to when its limits allow it."""
    due = C.apply_limits(F.col("ts").cast("timestamp"), *limits())
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), due.cast("timestamp_ntz").alias("due"))


@query("f1_due_by_mode", f"""WITH clocks AS (SELECT event_id, min(x) AS x FROM (SELECT event_id, ts, date_trunc('day', ts) + to_days(CAST(a.d AS INTEGER)) + to_minutes(t) AS x FROM events, range(9) a(d), (VALUES (390), (1110)) b(t)) WHERE x > ts AND (event_id % 2 = 0 OR isodow(x) < 6) GROUP BY 1),
wanted AS (SELECT event_id, CASE (event_id // 2) % 4 WHEN 0 THEN ts + to_seconds(900) WHEN 1 THEN ts + to_seconds(CASE event_type WHEN 'purchase' THEN 300 WHEN 'error' THEN 1000 ELSE 1500 END) WHEN 2 THEN x END AS t0 FROM events JOIN clocks USING (event_id)),
{_LIMITS} SELECT event_id AS page, due FROM moved""")
def f1_due_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a check of a page with a schedule by interval, adaptive, by clock times or by hand, within its limits."""
    mode = F.element_at(F.array(*[F.lit(m) for m in ("interval", "adaptive", "times", "manual")]), (F.floor(F.col("event_id") / 2) % 4 + 1).cast("int"))
    changed = F.when(F.col("event_type") == "error", F.lit(None).cast("boolean")).otherwise(F.col("event_type") == "purchase")
    start, end, days = limits()
    due = C.next_due(mode, F.col("ts").cast("timestamp"), F.lit(900), C.adaptive_next(F.lit(1000), changed, 300, 7200, 1.5), F.array(F.lit(390), F.lit(1110)), start, end, days)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), due.cast("timestamp_ntz").alias("due"))


@query("f4_adaptive_intervals", """WITH RECURSIVE r AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, CASE event_type WHEN 'purchase' THEN 'changed' WHEN 'error' THEN 'error' ELSE 'unchanged' END AS o FROM events),
f(page, n, i) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), 300 FROM r UNION ALL SELECT f.page, r.n, CASE r.o WHEN 'changed' THEN 300 WHEN 'error' THEN f.i ELSE least(CAST(floor(f.i * 1.5) AS INTEGER), 7200) END FROM f JOIN r ON r.page = f.page AND r.n = f.n + 1)
SELECT page, max_by(i, n) AS interval_s FROM f GROUP BY page""")
def f4_adaptive_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "changed").when(F.col("event_type") == "error", "error").otherwise("unchanged")
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts", kind.alias("outcome"))
    return C.adaptive_intervals(runs, "page", "ts", "outcome", 300, 7200, 1.5)


@query("f5_catch_up_plan", """WITH d AS (SELECT event_id AS page, event_id % 3 AS priority, ts AS due FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
r AS (SELECT page, row_number() OVER (ORDER BY priority DESC, due, page) - 1 AS place, count(*) OVER () AS n FROM d)
SELECT page, CAST(place AS BIGINT) AS place, CAST(round(round(place * least(3600.0, n) / n, 6), 3) AS DOUBLE) AS offset_s FROM r""")
def f5_catch_up_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event before noon as an overdue page, spread over an hour."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), (F.col("event_id") % 3).alias("priority"), F.col("ts").cast("timestamp").alias("due"))
    found = C.catch_up_plan(rows, NOW, 3600)
    offset = (F.unix_micros(F.col("start_at").cast("timestamp")) - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 1e6
    return found.select("page", "place", F.round(offset, 3).alias("offset_s"))


@query("f5_catch_up_limits", f"""WITH wanted AS (SELECT event_id, TIMESTAMP '2024-01-15 12:00:00' AS t0, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'), {_LIMITS},
r AS (SELECT event_id, row_number() OVER (ORDER BY event_id % 3 DESC, ts, event_id) - 1 AS place, count(*) OVER () AS n FROM wanted JOIN moved USING (event_id) WHERE due <= t0)
SELECT event_id AS page, CAST(place AS BIGINT) AS place, CAST(CASE WHEN place IS NULL THEN epoch_us(due) / 1e6 - epoch_us(TIMESTAMP '2024-01-15 12:00:00') / 1e6 ELSE round(round(place * least(3600.0, n) / n, 6), 3) END AS DOUBLE) AS offset_s FROM moved LEFT JOIN r USING (event_id)""")
def f5_catch_up_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catch-up plan of pages with limits: those that may not run at noon wait for their next allowed start."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("page"), (F.col("event_id") % 3).alias("priority"), F.col("ts").cast("timestamp").alias("due"), C.apply_limits(F.lit(NOW).cast("timestamp"), *limits()).alias("open_at"))
    found = C.catch_up_plan(rows, NOW, 3600, allowed="open_at")
    offset = (F.unix_micros(F.col("start_at").cast("timestamp")) - F.unix_micros(F.lit(NOW).cast("timestamp"))) / 1e6
    return found.select("page", "place", F.round(offset, 3).alias("offset_s"))


@query("e29_select_links", f"""WITH {LINKS}, k AS (SELECT l.page_id, l.n, l.url FROM links l JOIN pages p ON p.page_id = l.page_id WHERE regexp_extract(l.url, '://([^/?#]*)', 1) = lower(regexp_extract(p.url, '://([^/?#]*)', 1)) AND l.url <> p.url
 AND regexp_matches(l.url, '/[a-zA-Z]') AND NOT regexp_matches(l.url, '[,.]$') AND l.url NOT IN (SELECT url FROM pages))
SELECT url, arg_min(page_id, (page_id, n)) AS page, arg_min(n, (page_id, n)) AS n FROM k GROUP BY url""")
def e29_select_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    links = page_links(spark, sf_dir).join(p.select("page_id", F.col("url").alias("base")), "page_id").withColumnRenamed("page_id", "page")
    return crawl.select_links(links, "/[a-zA-Z]", "[,.]$", p)


@query("e30_crawl_frontier", """WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey * 1000 AS src, n_nationkey + 5000 AS dst FROM nation UNION SELECT c_nationkey + 5000, c_custkey + 10000 FROM customer UNION SELECT o_custkey + 10000, o_orderkey + 1000000 FROM orders),
t(root, node, level) AS (SELECT r_regionkey * 1000, r_regionkey * 1000, 0 FROM region UNION ALL SELECT t.root, e.dst, t.level + 1 FROM t JOIN e ON e.src = t.node WHERE t.level < 3)
SELECT root, node, level FROM t QUALIFY row_number() OVER (PARTITION BY root ORDER BY level, node) <= 2000""")
def e30_crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order as links, three deep, two thousand pages a root."""
    t = lambda n: table(spark, sf_dir, n)
    edges = t("nation").select((F.col("n_regionkey") * 1000).cast("long").alias("src"), (F.col("n_nationkey") + 5000).cast("long").alias("dst"))
    edges = edges.unionByName(t("customer").select((F.col("c_nationkey") + 5000).cast("long").alias("src"), (F.col("c_custkey") + 10000).alias("dst")))
    edges = edges.unionByName(t("orders").select((F.col("o_custkey") + 10000).alias("src"), (F.col("o_orderkey") + 1000000).alias("dst")))
    roots = t("region").select((F.col("r_regionkey") * 1000).cast("long").alias("node"))
    return crawl.crawl_frontier(edges, roots, 3, 2000)


@query("e31_robots", f"""WITH {LINKS}, u AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM links),
h AS (SELECT DISTINCT regexp_replace(host, ':[0-9]+$', '') AS host FROM u), r AS (SELECT host, path, allow FROM h, (VALUES ('/', true), ('/the', false), ('/de', false), ('/and', false)) v(path, allow))
SELECT u.url, coalesce((SELECT max_by(allow, length(r.path)) FROM r WHERE r.host = regexp_replace(u.host, ':[0-9]+$', '') AND starts_with(u.path, r.path)), true) AS allowed FROM u""")
def e31_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three closed prefixes on every host, applied to all links."""
    from chronodiff.functions.urls import host_of

    links = page_links(spark, sf_dir).select("url").distinct()
    rule = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in (("/", True), ("/the", False), ("/de", False), ("/and", False))]))
    rules = links.select(host_of(F.col("url")).alias("host")).distinct().select("host", rule.alias("r")).select("host", "r.path", "r.allow")
    return crawl.robots_allowed(links, rules).select("url", "allowed")


_CELLS = "c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(round(unnest(embedding) * 400 + 128) AS INTEGER) AS g FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str, flip: bool) -> DataFrame:
    """Embeddings as 8 x 8 gray pictures; the other side is a row shorter and darker on the diagonal."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot"), F.posexplode("embedding").alias("i", "v"))
    gray = F.round(F.col("v").cast("double") * 400 + 128).cast("int")
    out = rows.select("shot", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), gray.alias("gray"))
    return out.where("y < 7").withColumn("gray", F.when(F.col("x") == F.col("y"), F.col("gray") - 60).otherwise(F.col("gray"))) if flip else out


@query("c20_raster_change", f"""WITH {_CELLS}, d AS (SELECT vec_id AS shot, i % 8 AS x, i // 8 AS y, abs(g - CASE WHEN i // 8 = 7 THEN 255 WHEN i % 8 = i // 8 THEN g - 60 ELSE g END) > 24 AS differs FROM c)
SELECT shot, round(avg(CAST(differs AS DOUBLE)), 9) AS share, avg(CAST(differs AS DOUBLE)) >= 0.2 AS significant FROM d WHERE NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) GROUP BY shot""")
def c20_raster_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = raster.raster_delta(cells(spark, sf_dir, False), cells(spark, sf_dir, True), ((0, 0, 1, 1),))
    return raster.raster_change(diff, 0.2).withColumn("share", F.round("share", 9))


@query("c20_height_rule", f"""WITH {_CELLS}, d AS (SELECT vec_id AS shot, abs(g - CASE WHEN i // 8 = 7 THEN 255 WHEN i % 8 = i // 8 THEN g - 60 ELSE g END) > 24 AS differs FROM c)
SELECT shot, round(avg(CAST(differs AS DOUBLE)), 9) AS share, 12.5 AS percent, avg(CAST(differs AS DOUBLE)) > 0.5 OR 12.5 > 12 AS significant FROM d GROUP BY shot""")
def c20_height_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that lost a row of eight: significant by their height, however few cells differ."""
    old, new = cells(spark, sf_dir, False), cells(spark, sf_dir, True)
    found = raster.significant_change(raster.raster_delta(old, new), raster.height_change(old, new), 0.5, 12.0)
    return found.select("shot", F.round("share", 9).alias("share"), "percent", "significant")


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 32 x 16 cells, each of eight embeddings, with cells changed here and there."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    x, y = (F.col("vec_id") % 4) * 8 + F.col("i") % 8, F.floor((F.col("vec_id") % 8) / 4) * 8 + F.floor(F.col("i") / 8)
    return rows.select(F.floor(F.col("vec_id") / 8).alias("shot"), x.alias("x"), y.alias("y"), (F.pmod(F.floor(F.col("v") * F.lit(10_000).cast("float")), F.lit(31)) == 0).alias("differs"))


@query("c21_raster_regions", """WITH RECURSIVE p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings),
c AS MATERIALIZED (SELECT vec_id // 8 AS shot, (vec_id % 4) * 8 + i % 8 AS x, (vec_id % 8) // 4 * 8 + i // 8 AS y FROM p WHERE CAST(floor(v * CAST(10000 AS FLOAT)) AS BIGINT) % 31 = 0),
n AS MATERIALIZED (SELECT shot, x, y, y * 100 + x AS c FROM c),
r(shot, c, root) AS (SELECT shot, c, c FROM n UNION SELECT r.shot, b.c, r.root FROM r JOIN n a ON a.shot = r.shot AND a.c = r.c JOIN n b ON b.shot = a.shot AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 WHERE r.root < b.c),
m AS (SELECT shot, c, min(root) AS root FROM r GROUP BY ALL)
SELECT shot, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS cells FROM m JOIN n USING (shot, c) GROUP BY shot, root QUALIFY row_number() OVER (PARTITION BY shot ORDER BY count(*) DESC, min(y), min(x), max(y), max(x)) <= 50""")
def c21_raster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of changed cells: cells whose neighbourhoods touch belong together."""
    return raster.raster_regions(scattered(spark, sf_dir))
