"""Every stage of the pipeline on the whole small table against a plain version of it."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline as P
from chronodiff.llm import ftrl, toxicity
from chronodiff.llm.queries import vocab_file
from tests.llm.test_cases import jaccard_groups
from tests.oracle import views


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(views(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall())


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_toxicity(spark, sf_dir, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(ftrl.crc_bucket(F.col("doc_id"), 5) != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    kept = {r["doc_id"] for r in P.toxicity_stage(spark, docs, sf_dir).collect()}
    assert kept == {k for k, s in scores.items() if s < 0.5} and len(kept) > 0.8 * len(scores)


def test_lines(spark, sf_dir, docs, texts):
    seen, want = set(), {}
    for k in sorted(texts):
        if texts[k] is None:
            want[k] = None
            continue
        lines, gone = texts[k].split("\n"), set()
        for p in range(len(lines) - 2):
            three = tuple(lines[p : p + 3])
            if any(x.strip(" ") for x in three):
                if three in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(three)
        want[k] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    assert {r["doc_id"]: r["text"] for r in P.line_stage(spark, docs, sf_dir).collect()} == want


def test_near_duplicates(spark, sf_dir, docs, texts):
    groups = jaccard_groups(list(texts.items()), 5, 80)
    kept = {r["doc_id"] for r in P.near_stage(spark, docs, sf_dir).collect()}
    assert kept == {k for k, root in groups.items() if k == root}


def test_leaks(spark, sf_dir, docs, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for (text,) in views(sf_dir).sql("SELECT text FROM benchmark").fetchall():
        w = words(text)
        windows |= {tuple(w[p : p + 10]) for p in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {k for k, t in texts.items() if not any(tuple(w[p : p + n]) in windows for w in [words(t)] for n in sizes for p in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in P.leak_stage(spark, docs, sf_dir).collect()} == clean


def test_tokens(spark, sf_dir, docs, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocab_file())
    got = {r["doc_id"]: r["ids_sha256"] for r in P.token_stage(spark, docs, sf_dir).collect()}
    for k, t in texts.items():
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[k] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_of_odd_rows(spark, sf_dir, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "text without id", "en", "x", 3), (10**9, "", None, None, None)], docs.schema)
    for rows in (odd, docs.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, rows, sf_dir).count() == rows.count()
