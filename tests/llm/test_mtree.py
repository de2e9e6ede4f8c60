"""Top-k search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronodiff.llm import mtree

NAN, INF = float("nan"), float("inf")


def brute(rows, asks, k, scale=1024):
    whole = []
    for name, vec in dict.fromkeys((n, tuple(v) if v is not None else None) for n, v in rows):
        if name is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            whole.append((name, [math.floor(scale * x) for x in vec]))
    out = []
    for name, v in whole:
        if asks(name):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), other) for other, w in whole if other != name and len(w) == len(v))
            out += [(name, i + 1, other, -s) for i, (s, other) in enumerate(scored[:k])]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect())


def clusters(n, dim, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, dim))) * rng.uniform(0.5, 1.5, size=(n, 1))


@pytest.mark.parametrize("block", [40, 4096])
def test_equals_all_products(spark, monkeypatch, block):
    for name, value in (("BLOCK", block), ("LEAF", 6), ("INNER", 4), ("QUERIES", 3)):
        monkeypatch.setattr(mtree, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(clusters(700, 8))]
    rows += [(1000 + k, rows[20][1]) for k in range(40)]  # equal vectors
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, row int")
    assert got(mtree.top_k(frame, F.col("vec_id") % 20 == 0)) == brute(rows, lambda n: n % 20 == 0, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [1.0, None]), (400, [NAN, 1.0]), (500, [INF, 1.0]), (None, [9.0, 9.0]), (600, []), (700, []),
        (800, [1.0, 2.0, 3.0]), (900, [-1.0, -2.0]), (1000, [-1.0, -2.0]), (1, [1e6, -1e6]), (2, [3e-5, -3e-5]), (3, [1.0, 2.0]), (4, [1.0, 2.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 3, 10):
        assert got(mtree.top_k(frame, F.col("vec_id") % 100 == 0, k)) == brute(rows, lambda n: n % 100 == 0, k)
    assert got(mtree.top_k(frame.limit(0), F.col("vec_id") % 100 == 0)) == []
    with pytest.raises(Exception, match="64-bit"):
        mtree.top_k(spark.createDataFrame([(0, [1e9] * 4)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_stored_bounds_spare_computations():
    x = np.floor(1024 * clusters(4000, 6)).astype(np.int64)
    tree, order = mtree.Tree.build(x, int((x * x).sum(axis=1).max()))
    tree = mtree.Tree.load(tree.dump())
    ids = [[int(k)] for k in order]
    for q in range(0, 4000, 100):
        want = sorted((-int(s), k) for k, s in enumerate(x @ x[q]) if k != q)[:10]
        assert [(-s, k) for s, k in tree.search(x[q], 10, ids, q, None)] == want
    assert tree.computed < 40 * 4000 / 2
