"""The queries on the whole small tables: against SQL, brute force, the tokenizers library, or held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest

from chronodiff.llm import queries as q
from tests.oracle import same, views


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    same(q.QUERIES[name](spark, sf_dir), q.ORACLES[name], con)


def test_ids_and_texts_are_those_of_the_tokenizers_library(spark, sf_dir, con):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(q.vocab_file())
    got = {r["doc_id"]: r for r in q.op4_bpe(spark, sf_dir).collect()}
    docs = con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert len(got) == len(docs)
    for (doc, text), e in zip(docs, own.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        back = own.decode(e.ids, skip_special_tokens=False)
        want = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == want, text[:80]


def brute_repeats(docs):
    first, out = {}, {}
    for doc, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first.setdefault(text[p : p + 50], doc) < doc:
                gone[p : p + 50] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[doc] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_are_those_of_brute_force(spark, sf_dir, con):
    docs = [(d, t.encode()) for d, t in con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op6_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == brute_repeats(docs)


def held_out_accuracy(con, rows, label, parts, rest):
    labels = dict(con.sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(labels[r["doc_id"]] == r["predicted"])
    return np.mean(right)


def test_quality_on_held_out_rows(spark, con):
    sf = "/root/testdata/sf0.01"
    assert held_out_accuracy(views(sf), q.op9_quality(spark, sf).collect(), "quality", 3, 1) > 0.97


def test_toxicity_on_held_out_rows(spark, con):
    sf = "/root/testdata/sf0.01"
    assert held_out_accuracy(views(sf), q.op8_toxicity(spark, sf).collect(), "toxic", 5, 0) > 0.93


def test_language_on_held_out_rows(spark, con):
    sf = "/root/testdata/sf0.01"
    lang = dict(views(sf).sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in q.op7_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_lm_prefers_texts_to_their_shuffled_words(spark, sf_dir, con):
    from chronodiff.llm import lm

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.train(docs)
    assert np.allclose(np.exp(model.log_prob).sum(axis=2), 1, atol=1e-3)
    rng = np.random.default_rng(1)
    texts = [t for (t,) in con.sql("SELECT text FROM documents WHERE length(text) > 300").fetchall()]
    mixed = [" ".join(rng.permutation(t.split()).tolist()) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts + mixed)), "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(rows, model).collect()}
    n = len(texts)
    assert np.mean([got[k] for k in range(n)]) > np.mean([got[n + k] for k in range(n)])


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, out = docs.columns, docs
    for k, (_, stage) in enumerate(P.STAGES):
        before = out
        out = stage(spark, before, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
            out = spark.createDataFrame(out.toPandas(), docs.schema)
            assert 0.5 * before.count() < out.count() <= before.count()
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids))
    assert sorted(ids) == sorted(r["doc_id"] for r in P.run(spark, sf_dir).select("doc_id").collect())
