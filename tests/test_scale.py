"""Running totals, components and tiles against plain versions: ties of all rows, one hot key, many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from chronodiff.operators import capacity, crawl, prefix, raster, retention
from chronodiff.operators.graph import components


@pytest.mark.parametrize("tie", [True, False])
def test_running_totals(spark, tie):
    rng = random.Random(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as large rows would make
    rows = [(k, rng.choice(["hot", "hot", "b", None]), 7 if tie else rng.randrange(50), rng.randrange(-5, 9)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "id int, k string, at int, v int").repartition(5)
    got = {r["id"]: (r["total"], r["total_all"]) for r in prefix.running_total(frame, F.col("v"), ["at", "id"]).collect()}
    run, whole = 0, sum(r[3] for r in rows)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        run += r[3]
        assert got[r[0]] == (run, whole)
    own = {r["id"]: (r["n"], r["n_all"]) for r in prefix.running_total(frame, F.lit(1), ["at", "id"], ["k"], "n").collect()}
    for key in ("hot", "b", None):
        of = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [own[r[0]] for r in of] == [(k + 1, len(of)) for k in range(len(of))]
    held = prefix.ranged(frame, ["at", "id"], ["k"]).groupBy("_range").count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < len(rows) / 2  # the hot key and the tie are spread
    assert prefix.running_total(frame.limit(0), F.col("v"), ["at", "id"]).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_host_gaps_of_one_host(spark):
    rng = random.Random(4)
    runs = [("h", s, s + rng.randrange(0, 40)) for s in rng.sample(range(100_000), 2000)] + [("one", 5, 9)]
    frame = spark.createDataFrame(runs, "host string, s long, e long").select("host", *[F.timestamp_seconds(c).alias(c) for c in ("s", "e")])
    got = {r["host"]: (r["min_gap_s"], r["peak"]) for r in capacity.host_gaps(frame, "host", "s", "e").collect()}
    own = sorted(r[1:] for r in runs if r[0] == "h")
    events = sorted([(s, 1) for s, _ in own] + [(e, -1) for _, e in own])
    level = peak = 0
    for _, d in events:
        level += d
        peak = max(peak, level)
    assert got == {"h": (float(min(b[0] - a[0] for a, b in zip(own, own[1:], strict=False))), peak), "one": (None, 1)}


def test_cap_passes_protected_versions_over_and_changes_follow(spark):
    versions = spark.createDataFrame([(k, f"c{k % 4}", k, 10) for k in range(12)], "version int, content string, at int, bytes int").withColumn("at", F.timestamp_seconds("at"))
    gone = retention.cap_candidates(versions, 25, spark.createDataFrame([(1,), (99,)], "version int"))
    assert sorted((r["version"], r["fresh"]) for r in gone.collect()) == [(0, 10), (2, 10), (3, 10)]
    changes = spark.createDataFrame([(1, 0, 4), (2, 4, 3), (3, 4, 5), (4, None, 6)], "change int, old_version int, new_version int")
    left = retention.prune_changes(changes, gone)
    assert sorted((r["change"], r["old_version"]) for r in left.collect()) == [(1, None), (3, 4), (4, None)]


def test_frontier_never_expands_more_than_its_budget(spark):
    edges = [(0, k) for k in range(1, 200)] + [(k, 1000 + k * 10 + j) for k in range(1, 200) for j in range(10)] + [(1, 0), (1010, 1)]
    frame, roots = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (1,), (0,)], "node long")
    got = {}
    for r in crawl.crawl_frontier(frame, roots, 3, 50).collect():
        got.setdefault(r["root"], []).append((r["level"], r["node"]))
    assert sorted(got[0]) == [(0, 0)] + [(1, k) for k in range(1, 50)]
    assert sorted(got[1])[:3] == [(0, 1), (1, 0), (1, 1010)] and len(got[1]) == 50


def plain_regions(cells):
    left, out = set(cells), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            x, y = todo.pop()
            own.append((x, y))
            near = {c for c in left if abs(c[0] - x) <= 3 and abs(c[1] - y) <= 3}
            left -= near
            todo += near
        out.append((min(x for x, _ in own), min(y for _, y in own), max(x for x, _ in own), max(y for _, y in own), len(own)))
    return sorted(out)


def test_regions_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 8)
    rng = random.Random(6)
    shots = {1: {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}, 2: {(100_000, 0), (0, 1)}, 3: {(k, k // 2) for k in range(50)}, 4: set()}
    rows = [(s, x, y, True) for s, own in shots.items() for x, y in own] + [(4, 1, 1, False)]
    frame = spark.createDataFrame(rows, "shot int, x int, y int, differs boolean")
    got = {}
    for r in raster.raster_regions(frame, 500).collect():
        got.setdefault(r["shot"], []).append(tuple(r)[1:])
    assert {s: sorted(v) for s, v in got.items()} == {s: plain_regions(own) for s, own in shots.items() if own}
    monkeypatch.setattr(raster, "MAX_GROUPED_CELLS", 50)
    one = raster.raster_regions(frame.where("shot = 1")).collect()
    xs, ys = zip(*shots[1], strict=True)
    assert [tuple(r)[1:] for r in one] == [(min(xs), min(ys), max(xs), max(ys), len(shots[1]))]


def test_height_alone_is_significant(spark):
    tall = spark.createDataFrame([(s, 0, y, 0) for s, h in ((1, 100), (2, 100)) for y in range(h)], "shot int, x int, y int, gray int")
    new = spark.createDataFrame([(s, 0, y, 0) for s, h in ((1, 94), (2, 96), (3, 5)) for y in range(h)], "shot int, x int, y int, gray int")
    got = {r["shot"]: (r["percent"], r["significant"]) for r in raster.significant_change(raster.raster_delta(tall, new), raster.height_change(tall, new), 0.9).collect()}
    assert got == {1: (6.0, True), 2: (4.0, False), 3: (500.0, True)}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(1000, 1001), (5, 5)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(k, 0) for k in range(501)} | {(1000, 1000), (1001, 1000)}
