"""Scores of whole tables against plain re-computations, text by text, from the models' weights."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronodiff.llm import ftrl, langid, lm, quality, toxicity
from chronodiff.llm.textnum import hash_spans
from chronodiff.session import table

ODD = [(-1, None), (-2, ""), (-3, "..."), (-4, "same words same words"), (-4, "same words same words"), (-5, "x" * 5000 + " long " * 3000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.unionByName(odd).withColumn("a.b", F.lit(1)).withColumn("score", F.lit("x")).cache()


def alone(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def logistic(model, features, text):
    _, idx, val = features(*alone(text))
    z = sum(float(model.weights[i]) * float(v) for i, v in zip(idx, val, strict=True)) + float(model.bias)
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_sparse_dot_products(spark, sf_dir, docs, which):
    labels = table(spark, sf_dir, "labels")
    own = quality if which == "quality" else toxicity
    model = quality.train(docs, labels, "quality") if which == "quality" else toxicity.train(docs, labels)
    got = sorted((r["doc_id"], r["score"]) for r in own.score(docs, model).collect())
    want = sorted((r["doc_id"], logistic(model, own.features, r["text"])) for r in docs.collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-9


def test_language_by_n_grams(spark, sf_dir, docs):
    model = langid.train(table(spark, sf_dir, "documents").where(ftrl.crc_bucket(F.col("doc_id"), 4) != 2))
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()), key=lambda r: r[0])
    want = []
    for r in docs.collect():
        bucket, _, letters = langid._grams([r["text"] or ""])
        z = [(sum(float(model.weights[g, k]) for g in bucket) * langid.SCALE / max(len(bucket), 1) + float(model.bias[k])) / model.temperature for k in range(len(model.langs))]
        p = [math.exp(x - max(z)) for x in z]
        best = z.index(max(z))
        want.append((r["doc_id"], model.langs[best], p[best] / sum(p)) if letters[0] else (r["doc_id"], "und", 0.0))
    want.sort(key=lambda r: r[0])
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-6


def plain_log_prob(model, text):
    """(sum of log p, tokens): each word from two on either side, by its path in the tree and, if rare, its letters."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    ids = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        ids.append(int(model.vocabulary.ids(hash_spans(raw, np.array([0]), np.array([len(raw)])).view(np.int64))[0]))
    total = 0.0
    for k, i in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else 0 for j in (*range(k - lm.SIDE, k), *range(k + 1, k + lm.SIDE + 1))]
        hidden = np.tanh(model.par["c"] + sum(model.par[name][a] for name, a in zip(lm.NEIGHBOURS, around, strict=True)))
        for step in range(model.tree.begin[i - 1], model.tree.begin[i]):
            node, side = model.tree.node[step], model.tree.side[step]
            z = float(model.par["U"][node] @ hidden) + float(model.par["b"][node])
            total -= math.log1p(math.exp(-side * z)) if -side * z < 30 else -side * z
        if i == model.vocabulary.rare:
            raw, heads = lm.spelled(np.frombuffer(words[k], np.uint8), np.array([0]), np.array([len(words[k])]))
            total += sum(float(model.spelling[a, b]) for a, b in zip(raw[:-1].tolist(), raw[1:].tolist(), strict=True))
    return total, len(ids)


def test_pseudo_likelihood(docs):
    model = lm.train(docs)
    some = docs.where("doc_id < 60")
    got = sorted((r["doc_id"], r["log_prob"], r["n_tokens"]) for r in lm.score(some, model).collect())
    want = sorted((r["doc_id"], *plain_log_prob(model, r["text"])) for r in some.collect())
    assert [(k, n) for k, _, n in got] == [(k, n) for k, _, n in want]
    assert max(abs(a[1] - b[1]) / max(1, abs(b[1])) for a, b in zip(got, want, strict=True)) < 1e-5
    around = np.zeros((model.vocabulary.rare, 2 * lm.SIDE), np.int64)
    assert abs(np.exp(model.tokens(around, np.arange(1, model.vocabulary.rare + 1))).sum() - 1) < 1e-6
