"""Queries on ordered scripts, and on streams that read the given tables and end when these are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodiff.functions.text import normalize_text
from chronodiff.operators import align, delta
from chronodiff.plans.changes import turn_versions
from chronodiff.plans.registry import query
from chronodiff.plans.sql import TURN_DELTA, TURN_VERSIONS, words
from chronodiff.session import shared_folder, table
from chronodiff.streaming import stream as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` as a stream of its files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now; its rows as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def turn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), normalize_text), lambda x: x != "")
    return turn_versions(spark, sf_dir).withColumn("blocks", lines)


def turn_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``old_blocks`` and ``new_blocks`` of every changed turn."""
    v = turn_arrays(spark, sf_dir)
    old = v.select("conv_id", F.col("turn").alias("latest_at"), F.col("blocks").alias("old_blocks"))
    return v.where("outcome = 'stored'").select("conv_id", "turn", "latest_at", F.col("blocks").alias("new_blocks")).join(old, ["conv_id", "latest_at"])


@query("c3_c4_align_blocks")
def c3_c4_align_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_blocks(turn_block_pairs(spark, sf_dir), ["conv_id", "turn"])


@query("c8_changed_text")
def c8_changed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.changed_text(align.align_blocks(turn_block_pairs(spark, sf_dir), ["conv_id", "turn"])).select("conv_id", "turn", "op", "added", "removed")


@query("d6_cumulative_gate")
def d6_cumulative_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.gate_cumulative(turn_arrays(spark, sf_dir).where("reject is null"), "conv_id", "turn", 60)


@query("g1_stream_changes", f"WITH {TURN_VERSIONS} SELECT conv_id AS page, turn AS moment, outcome FROM classified")
def g1_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all turns, from a stream of them."""
    rows = delta.version_hashes(read_stream(spark, sf_dir, "conversations"), "text").withColumn("reject", delta.bad_fetch(F.col("text"), 40))
    found = drain(S.stream_changes(rows.select(F.col("conv_id").alias("page"), F.col("turn").alias("at"), "raw_hash", "filtered_hash", "reject")))
    return found.withColumnRenamed("at", "moment")


@query("g2_stream_record_events", """WITH s AS (SELECT user_id, event_id // 1000 AS snap, event_type AS rid, CAST(max(event_id) AS VARCHAR) AS row FROM events GROUP BY ALL), n AS (SELECT user_id, snap, dense_rank() OVER (PARTITION BY user_id ORDER BY snap) AS k FROM (SELECT DISTINCT user_id, snap FROM s)),
r AS (SELECT s.*, k FROM s JOIN n USING (user_id, snap)), b AS (SELECT cur.user_id, cur.snap, cur.rid, CASE WHEN p.rid IS NULL THEN 'new' WHEN p.row <> cur.row THEN 'changed' END AS event FROM r cur LEFT JOIN r p ON p.user_id = cur.user_id AND p.k = cur.k - 1 AND p.rid = cur.rid WHERE cur.k > 1
UNION ALL SELECT p.user_id, n.snap, p.rid, 'removed' FROM r p JOIN n ON n.user_id = p.user_id AND n.k = p.k + 1 LEFT JOIN r cur ON cur.user_id = p.user_id AND cur.k = n.k AND cur.rid = p.rid WHERE cur.rid IS NULL)
SELECT user_id AS source, snap, rid, event FROM b WHERE event IS NOT NULL""")
def g2_stream_record_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of each kind in every thousand events as a snapshot of records."""
    batch = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.floor(F.col("event_id") / 1000).alias("snap"), F.col("event_type").alias("rid"), "event_id")
    batch = batch.groupBy("source", "snap", "rid").agg(F.max("event_id").cast("string").alias("row"))
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    batch.write.parquet(path)
    return drain(S.stream_record_events(spark.readStream.schema(batch.schema).parquet(path)))


@query("g3_coalesce_alerts", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts, event_type FROM events),
r(user_id, start) AS (SELECT user_id, min(ts) FROM e GROUP BY 1 UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= r.start + INTERVAL 6 HOUR GROUP BY r.user_id),
w AS (SELECT r.user_id, start, list(event_type ORDER BY ts, event_type) AS p FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= start AND e.ts < start + INTERVAL 6 HOUR GROUP BY ALL)
SELECT user_id, start, len(p) AS n, CASE WHEN len(p) = 1 THEN p[1] ELSE len(p) || ' pages changed: ' || array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN ' and ' || (len(p) - 3) || ' more' ELSE '' END END AS notice
FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def g3_coalesce_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notice a user for all events within six hours of the first, from a stream, by timers."""
    rows = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = drain(S.coalesce_alerts(rows, "user_id", "event_type", "ts", 6 * 3_600_000))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("g4_dedupe_alerts", "SELECT DISTINCT user_id, event_type FROM events")
def g4_dedupe_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, kind) once within forty days."""
    rows = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(S.dedupe_alerts(rows, "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type"))


@query("g5_stream_metrics", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def g5_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly metrics of all windows that the two-hour watermark has closed."""
    rows = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = drain(S.stream_metrics(rows, "ts", "event_type", "value", "1 hour", "2 hours"))
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), "high")


@query("g6_stream_stale", """WITH n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM (SELECT DISTINCT user_id, ts FROM events))
SELECT user_id, ts AS since, ts + INTERVAL 3 DAY AS until FROM n WHERE (after IS NULL OR after >= ts + INTERVAL 3 DAY) AND ts + INTERVAL 3 DAY <= (SELECT max(ts) FROM events)""")
def g6_stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whom three days have passed without an event, by timers; once for each quiet time."""
    rows = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = drain(S.stream_stale(rows, "user_id", "ts", 3))
    return found.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"))


def remember_streak(state: dict[str, str], at, outcome: str) -> str | None:  # noqa: ANN001, ARG001
    """A hook: how many events of one kind came in a row, told at every third."""
    n = int(state.get("n", "0")) + 1 if state.get("kind") == outcome else 1
    state.update(kind=outcome, n=str(n))
    return f"{outcome} x {n}" if n % 3 == 0 else None


@query("h5_hook_state", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, g ORDER BY ts, event_id) AS n FROM o)
SELECT event_id, CASE WHEN n % 3 = 0 THEN event_type || ' x ' || n END AS told FROM n""")
def h5_hook_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's hook over a stream of events with a memory for each user; the order of events is by time, then id."""
    rows = read_stream(spark, sf_dir, "events")
    at = F.format_string("%020d %020d", F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))
    found = drain(S.stream_hook_state(rows.select(F.col("user_id").alias("page"), at.alias("at"), F.col("event_type").alias("outcome")), remember_streak))
    return found.select(F.substring("at", 22, 20).cast("long").alias("event_id"), "told")


@query("g7_stream_status", """WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN greatest(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1, 0) ELSE 0 END AS streak FROM g)
SELECT event_id AS run, user_id AS page, CAST(streak AS INTEGER) AS streak, CASE WHEN streak >= 3 THEN 'error' WHEN streak > 0 THEN 'warning' ELSE 'ok' END AS status FROM s""")
def g7_stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_stream(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("page"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("error"))
    return drain(S.stream_status(rows))


@query("g1_stream_gate")
def g1_stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative gate on a stream of versions; the same verdicts as ``d6_cumulative_gate``."""
    batch = turn_arrays(spark, sf_dir).where("reject is null").select(F.col("conv_id").alias("page"), F.col("turn").alias("at"), "blocks")
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    batch.write.parquet(path)
    return drain(S.stream_gate(spark.readStream.schema(batch.schema).parquet(path), 60))


@query("c5_script_stats", f"""WITH {TURN_DELTA}, w AS (SELECT p.conv_id, p.turn, sum(d * {words("text")}) AS net, count(*) FILTER (d > 0) AS n_new, count(*) FILTER (d < 0) AS n_old
FROM pairs p LEFT JOIN sides s USING (conv_id, turn) GROUP BY ALL) SELECT conv_id, turn, CAST(coalesce(net, 0) AS BIGINT) AS net_words, CAST(n_new AS BIGINT) AS new_blocks, CAST(n_old AS BIGINT) AS old_blocks FROM w""")
def c5_script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operations of a script add up to: they cover both sides, and words in less words out is the difference of the sides."""
    ops = align.align_blocks(turn_block_pairs(spark, sf_dir), ["conv_id", "turn"], moves=False)
    side = lambda lo, hi: F.sum(F.when(F.col(lo) >= 0, F.col(hi) - F.col(lo) + 1).otherwise(0)).cast("long")
    return ops.groupBy("conv_id", "turn").agg(F.sum(F.col("added_words") - F.col("removed_words")).cast("long").alias("net_words"), side("new_lo", "new_hi").alias("new_blocks"), side("old_lo", "old_hi").alias("old_blocks"))


@query("c9_render_marks")
def c9_render_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.render_marks(turn_block_pairs(spark, sf_dir), ["conv_id", "turn"])
