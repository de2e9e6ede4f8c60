"""The run-length index: samples at run ends, matching statistics, rounds, and anchors too hot for one task."""

import numpy as np
import pytest

from chronodiff.llm import repeats as R
from tests.llm.test_queries import brute_repeats


def near_copies(n, edits, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 123, R.WIDEST).astype(np.uint8)
    out = set()
    while len(out) < n:
        t = base.copy()
        t[rng.integers(0, len(t), edits)] = rng.integers(97, 123, edits)
        out.add(t[: rng.integers(R.MATCH, R.WIDEST + 1)].tobytes())
    return sorted(out)


def laid_out(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def index_of(texts):
    buf, off = laid_out(texts)
    return R.RunIndex(*R._taken(buf, off, np.arange(len(texts))), np.arange(len(texts)))


def test_samples_are_those_of_run_ends():
    index = index_of(near_copies(400, 2))
    assert len(index.sample) <= 2 * len(index.run) < 0.4 * len(index.text)


def test_above_is_the_row_before():
    texts = near_copies(60, 3) + [b"ab" * 30, b"ab" * 35]
    buf, off = laid_out(texts)
    sym, size = R._taken(buf, off, np.arange(len(texts)))
    left = np.repeat(np.cumsum(size + 1), size + 1) - np.arange(len(sym))
    rows = [p for _, p in sorted((sym[p : p + left[p]].tobytes(), p) for p in range(len(sym)))]
    assert R.suffix_order(sym, left).tolist() == rows
    assert index_of(texts).above(np.array(rows[1:])).tolist() == rows[:-1]


@pytest.mark.parametrize("start", [100, 2000, None])
def test_first_documents_against_brute_force(start):
    rng = np.random.default_rng(1)
    texts = near_copies(150, 2) + [b"ab" * 30, b"a" * 77, b"a" * 60, b"abc" * 20, bytes(rng.integers(97, 123, 70).astype(np.uint8))]
    docs = rng.integers(0, 80, len(texts))
    first = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for p in range(len(t) - R.MATCH + 1):
            first[t[p : p + R.MATCH]] = min(first.get(t[p : p + R.MATCH], d), d)
    want = [first[t[p : p + R.MATCH]] for t in texts for p in range(len(t) - R.MATCH + 1)]
    assert R.first_documents(*laid_out(texts), docs, start).tolist() == want


def hot_line(n):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz ,."))
    line = "this one line stands in very many documents, each time between other words of its own. "
    side = lambda: "".join(rng.choice(letters, 40))
    texts = [side() + line + side() for _ in range(n)]
    return texts + [t[10:120] for t in texts[:20]]


@pytest.mark.parametrize(("hot", "large"), [(30, 0), (10**9, 0), (30, 10**9)])
def test_an_anchor_with_many_surroundings(spark, monkeypatch, hot, large):
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "LARGE", large)
    texts = hot_line(600)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in R.remove_repeats(rows).collect()}
    assert got == brute_repeats([(k, t.encode()) for k, t in enumerate(texts)])
