"""Streams that read files batch by batch: timers, late rows, restarts, deliveries and batches that come again."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronodiff.operators import align, hooks
from chronodiff.plans.streams import ROCKS
from chronodiff.sources import sinks
from chronodiff.streaming import stream as S

START = datetime(2024, 1, 1, 12)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Feed:
    """A stream of files, each its own batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, f"{folder}/in", schema, 0
        os.makedirs(self.folder)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/part{self.n:03}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def run(frame, folder, **trigger):
    frame.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).format("parquet").start(f"{folder}/out").awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/out")


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_one_notice_from_the_first_alert(spark, tmp_path):
    feed = Feed(spark, tmp_path, "owner string, page string, at timestamp")
    feed.put([("me", "a", at(0)), ("me", "b", at(29)), ("me", "c", at(31)), ("you", "x", at(5))])
    feed.put([("me", "d", at(20)), ("me", "e", at(30)), ("me", "f", at(62))])  # d is late, but within the delay
    feed.put([("me", "z", at(1000))])
    feed.put([("me", "gone", at(1))])  # later than the delay: dropped
    rows = run(S.coalesce_alerts(feed.stream(), "owner", "page", "at", 30_000, "40 seconds"), tmp_path).collect()
    got = sorted((r["owner"], (r["start"] - START).total_seconds(), r["n"], r["notice"]) for r in rows)
    # at 0: a, d, b; then e opens at 30 and takes c; then f opens at 62
    assert got == [("me", 0.0, 3, "3 pages changed: a, d, b"), ("me", 30.0, 2, "2 pages changed: e, c"), ("me", 62.0, 1, "f"), ("you", 5.0, 1, "x")]


def test_quiet_pages_are_told_once_without_input(spark, tmp_path):
    day = 86_400
    feed = Feed(spark, tmp_path, "page string, at timestamp")
    feed.put([("p", at(0)), ("q", at(day)), ("p", at(9 * day))])
    feed.put([("q", at(10 * day)), ("r", at(11 * day))])
    feed.put([("r", at(12 * day))])
    feed.put([("r", at(30 * day))])
    rows = run(S.stream_stale(feed.stream(), "page", "at", 3), tmp_path).collect()
    got = sorted((r["page"], (r["since"] - START).days, (r["until"] - START).days) for r in rows)
    assert got == [("p", 0, 3), ("p", 9, 12), ("q", 1, 4), ("q", 10, 13), ("r", 12, 15)]


def test_hook_memory_survives_a_restart_and_starts_from_a_table(spark, tmp_path):
    def hook(state, when, outcome):
        state["n"] = str(int(state.get("n", "0")) + 1)
        if outcome == "forget":
            state.clear()
        return state.get("n")

    feed = Feed(spark, tmp_path, "page string, at int, outcome string")
    initial = spark.createDataFrame([("p", "n", "40")], "page string, name string, value string")
    make = lambda: S.stream_hook_state(feed.stream(), hook, ttl_ms=3_600_000, initial=initial)
    feed.put([("p", 2, "x"), ("p", 1, "x"), ("q", 1, "x")])
    run(make(), tmp_path, once=True)  # with a time to live, batches without input never end
    feed.put([("p", 3, "x"), ("q", 2, "forget")])
    run(make(), tmp_path, once=True)  # a new query on the same checkpoint
    feed.put([("p", 4, "x"), ("q", 3, "x")])
    rows = run(make(), tmp_path, once=True).collect()
    assert sorted((r["page"], r["at"], r["told"]) for r in rows) == sorted([("p", 1, "41"), ("p", 2, "42"), ("q", 1, "1"), ("p", 3, "43"), ("q", 2, None), ("p", 4, "44"), ("q", 3, "1")], key=lambda r: (r[0], r[1]))


def test_deliveries_have_checkpoints_of_their_own(spark, tmp_path):
    feed = Feed(spark, tmp_path, "page string, reason string")
    feed.put([("a", None), ("b", "below_threshold")])
    seen = {"one": [], "two": []}
    for name in seen:
        own = hooks.Hooks(on_change=(lambda rows, n, name=name: seen[name].extend(r["page"] for r in rows.collect()),), after_check=(sinks.sink(f"{tmp_path}/{name}", ("page",)),))
        hooks.deliver(feed.stream(), own, name).awaitTermination()
        assert {r["page"]: r["batch"] for r in sinks.read_batches(spark, f"{tmp_path}/{name}").collect()} == {"a": 0, "b": 0}
    assert seen == {"one": ["a"], "two": ["a"]}


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "id int, kind int")
    for batch in (0, 1, 1, 0):
        sinks.write_batch(rows.where(F.col("id") % 2 == batch), str(tmp_path / "out"), batch, ("kind",))
    before = len(files(tmp_path / "out"))
    sinks.write_batch(rows.where("id % 2 = 1 and kind < 2"), str(tmp_path / "out"), 1, ("kind",))  # a shorter try leaves nothing of the longer one
    got = sinks.read_batches(spark, str(tmp_path / "out"))
    assert got.where("batch = 0").count() == 15 and got.where("batch = 1").count() == 10 and len(files(tmp_path / "out")) < before


def test_operations_as_json(spark):
    pair = spark.createDataFrame([(1, ["same", "one two", "gone"], ["same", "one three", "new", "more"])], "id int, old_blocks array<string>, new_blocks array<string>")
    diff = json.loads(sinks.diff_json(align.align_blocks(pair, ["id"]), ["id"]).first()["diff"])
    assert diff["ops"][0] == {"t": "eq", "old": [0, 0], "new": [0, 0]} and diff["degraded"] is False
    assert [o["t"] for o in diff["ops"]] == ["eq", "rep"] and diff["ops"][1]["old"] == [1, 2] and diff["ops"][1]["new"] == [1, 3]
    assert {k for k, _ in diff["ops"][1]["tokens"]} == {"eq", "del", "ins"} and diff["stats"]["changed_blocks"] == 3


def test_hooks_before_and_on_pages(spark):
    own = hooks.Hooks(skip=(F.col("page") == "s",), merge=(lambda d: d.withColumn("body", F.concat("body", F.lit("+"))), lambda d: d.withColumn("body", F.upper("body"))), preprocess=(lambda b: b.where("text <> 'ad'"), lambda b: b.withColumn("text", F.lower("text"))))
    pages = spark.createDataFrame([("p", "a"), ("s", "b"), (None, "c")], "page string, body string")
    assert sorted(r["body"] for r in hooks.merged(hooks.checked(pages, own), own).collect()) == ["A+", "C+"]
    blocks = spark.createDataFrame([(0, "Ad"), (1, "ad"), (2, "Text")], "pos int, text string")
    assert [r["text"] for r in hooks.preprocessed(blocks, own).orderBy("pos").collect()] == ["ad", "text"]
    empty = hooks.Hooks()
    assert hooks.merged(pages, empty).count() == hooks.checked(pages, empty).count() == 3 and hooks.preprocessed(blocks, empty).count() == 3
