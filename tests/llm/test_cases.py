"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash, for every operator."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronodiff.llm import bpe, ftrl, langid, leaks, lines, lm, near, quality, repeats, toxicity, vectors
from chronodiff.llm.queries import vocab_file
from chronodiff.llm.tables import components

LONG = " ".join(f"word{k % 997} {k}" for k in range(30_000))
PASSAGE = "this passage of some words is longer than fifty bytes for sure and repeats"
TEXTS = [None, "", " \n\t ", "one", "two words", PASSAGE, PASSAGE, f"before it {PASSAGE} after it", LONG, LONG, "漢字 é ñ ß\n\n\nline\nline\nline", "!!! *** 123", "\x00\x01 odd"]
SCHEMA = "doc_id long, text string, id string, h string, s int, lines string, sketch string, label int, n long, score string"


def test_columns_named_like_ours(spark):
    d = spark.createDataFrame([(1, PASSAGE, 1, 2, 3), (2, PASSAGE, 1, 2, 3)], "doc_id long, text string, near_id int, hit_id int, cut_0 int")
    items = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    assert near.drop_near_duplicates(d).columns == leaks.decontaminate(d, items).columns == lines.dedup_lines(d).columns == d.columns
    assert near.drop_near_duplicates(d).count() == 1 and leaks.decontaminate(d, items).count() == 2


def docs(spark, texts=TEXTS, extra=True):
    rows = [(k, t, "x", None, 1, "y", "z", None, 7, "q") for k, t in enumerate(texts)]
    if extra:
        rows += [rows[-6], rows[-5], (None, PASSAGE, "x", None, 1, "y", "z", None, 7, "q")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=60):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(n)] + [(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")


def corpus(spark, n=60):
    return docs(spark, [f"you idiot scum number {k} trash" if k % 2 else f"a calm and friendly text number {k}" for k in range(n)] + TEXTS)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines(spark):
    d = docs(spark, ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", None, "\n\n\n\n", "\n\n\n\n", "q\nq\nq\nq"], extra=False)
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(d).orderBy("doc_id").collect()]
    assert got == [(0, "a\nb\nc\nd"), (1, "x\ny"), (2, "a\nb"), (3, None), (4, "\n\n\n\n"), (5, "\n\n\n\n"), (6, "q")]
    whole = docs(spark)
    out = lines.dedup_lines(whole)
    assert out.columns == whole.columns and out.count() == whole.count()
    assert lines.dedup_lines(empty(spark)).count() == 0 and lines.line_report(empty(spark)).count() == 0


def test_leaks(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, "two words"), (3, None), (4, ""), (5, "one"), (None, "one"), (6, "漢字")], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks.leak_report(docs(spark), items).collect()}
    assert got[5]["n_hit"] == got[5]["n_words"] == 14 and got[5]["items"] == ["1"]
    assert got[4]["items"] == ["2"] and got[3]["items"] == ["5"] and got[10]["items"] == ["6"]
    assert got[0]["n_words"] == got[1]["n_words"] == got[2]["n_words"] == got[8]["n_hit"] == 0
    kept = leaks.decontaminate(docs(spark), items)
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 8, 9, 11, 12, None}
    assert leaks.leak_report(empty(spark), items).count() == 0
    assert leaks.decontaminate(docs(spark), items.limit(0)).count() == docs(spark).count()


def test_leaks_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_SHINGLES", 0)
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert {r["doc_id"] for r in leaks.leak_report(docs(spark), items).where("n_hit > 0").collect()} == {5, 6, 7}


def test_bpe(spark):
    d = docs(spark)
    got = bpe.encode(d, vocab_file(), decode=True).collect()
    assert len(got) == d.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == 0 and by[0]["decoded"] == ""
    assert all(by[k]["decoded"] == t for k, t in enumerate(TEXTS) if t is not None)
    back = bpe.decode(bpe.encode(d, vocab_file()), vocab_file())
    assert sorted(r["text"] for r in back.collect()) == sorted(r["decoded"] for r in got)
    assert bpe.encode(empty(spark), vocab_file()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="a b'sté\n1!<|endoftext|>", max_size=80))
def test_bpe_is_the_tokenizers_library(text):
    from tokenizers import Tokenizer

    own = bpe.codec(vocab_file())
    theirs = Tokenizer.from_file(vocab_file()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == theirs


def jaccard_groups(texts, size, percent):
    import re

    sets = {}
    for k, t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        if w:
            sets[k] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))}
    root = {k: k for k, _ in texts}
    find = lambda k: k if root[k] == k else find(root[k])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k, _ in texts}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 400, 120)] for _ in range(3)]
    texts = list(TEXTS)
    for k in range(150):
        w = list(base[k % 3])
        for p in rng.integers(0, len(w), rng.integers(0, 9)):
            w[p] = f"new{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    got = {r["id"]: r["component"] for r in near.near_duplicates(docs(spark, texts, extra=False), size=3, percent=85).collect()}
    assert got == jaccard_groups(list(enumerate(texts)), 3, 85)


def test_near_duplicates_cases(spark):
    d = docs(spark)
    kept = near.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 10, 11, 12]
    assert near.near_duplicates(empty(spark)).count() == 0


def test_repeats(spark):
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark)).collect()}
    n = len(PASSAGE)
    assert (got[5]["n_removed"], got[6]["n_removed"], got[9]["n_removed"]) == (0, n, len(LONG))
    assert (got[7]["n_removed"], got[7]["n_spans"]) == (n + 2, 1) or got[7]["n_removed"] == n
    assert got[0]["n_bytes"] == got[1]["n_bytes"] == 0 and got[None]["n_removed"] == 0
    assert repeats.remove_repeats(docs(spark)).count() == docs(spark).count()
    assert repeats.remove_repeats(empty(spark)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the quick brown fox jumps over the lazy dog again and ", "ab" * 30, "é漢" * 12, "x", PASSAGE, "a" * 49, "unique "]), max_size=5), min_size=1, max_size=8))
def test_repeats_against_brute_force(spark, parts):
    from tests.llm.test_queries import brute_repeats

    texts = ["".join(p) for p in parts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(d).collect()}
    assert got == brute_repeats([(k, t.encode()) for k, t in enumerate(texts)])


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 8))
    x[80:120] = x[:40] + rng.normal(size=(40, 8)) * 0.15
    x[120:140] = x[5] + rng.normal(size=(20, 8)) * 0.2
    x[150] = x[3]
    rows = [(k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, [], 1), (205, [float("inf")] * 8, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (None, rows[0][1], 1), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {(r["id"]): (r["n_links"], r["component"]) for r in vectors.near_duplicate_vectors(df).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(160)
    for _ in range(160):
        comp = np.array([min([comp[k], *comp[link[k]]]) for k in range(160)])
    want = {k: (int(link[k].sum()), int(comp[k])) for k in range(160)} | {k: (0, k) for k in (200, 201, 202, 203, 204, 205)} | {206: (1, 206), 207: (1, 206), None: (0, None)}
    assert got == want
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("op", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, op, label):
    d = corpus(spark)
    model = op.train(d, labels(spark), label)
    got = {r["doc_id"]: r["score"] for r in op.score(d, model).collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(60))
    assert got[60] == got[61] and 0 <= got[60] <= 1
    assert op.score(empty(spark), model).count() == 0
    assert {r["score"] for r in op.score(d, op.train(d, labels(spark).limit(0), label)).collect()} == {0.5}
    op.train(empty(spark), labels(spark), label)


def test_toxic_documents_go(spark):
    d = corpus(spark)
    model = toxicity.train(d, labels(spark))
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.where("doc_id < 60").collect()} == set(range(0, 60, 2))
    assert toxicity.drop_toxic(empty(spark), model).count() == 0


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    rates = np.where(y[:, None], [0.9, 0.8, 0.5, 0.7], [0.02, 0.05, 0.5, 0.1])
    votes = (rng.random((len(y), 4)) < rates) @ (1 << np.arange(4))
    gold = np.stack([np.bincount(votes[:400][y[:400] == k], minlength=16) for k in (0, 1)], axis=1).astype(float)
    model = toxicity.fit_label_model(np.bincount(votes[400:], minlength=16).astype(float), gold, voters=4)
    assert model.accuracy[0] > model.accuracy[2] and abs(model.accuracy[2]) < 0.5
    assert model.posterior[0b1011] > 0.9 > 0.1 > model.posterior[0]


def test_languages(spark):
    a, b = "the cat and the dog are in the house", "der hund und die katze sind in dem haus"
    rows = [(k, f"{a if k % 2 else b} {k}", "en" if k % 2 else "de") for k in range(40)] + [(40, None, "en"), (41, "12 !", None), (42, "", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d, model).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "de") for k in range(40))
    assert got[40] == got[41] == got[42] == ("und", 0.0)
    assert langid.identify(d.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, langid.train(d.limit(0))).collect()} == {"und"}


def test_lm_cases(spark):
    d = docs(spark)
    got = {r["doc_id"]: r for r in lm.score(d, lm.train(d)).collect()}
    assert all(got[k]["n_tokens"] == 0 and got[k]["log_prob"] == 0 for k in (0, 1, 2))
    assert got[8]["n_tokens"] == 60_000 and got[8]["log_prob"] < 0
    assert lm.score(empty(spark), lm.train(empty(spark))).count() == 0


def test_ftrl_zeroes_what_does_not_matter():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    idx = np.concatenate([[v, 2 + rng.integers(0, 50)] for v in y])
    w, _ = ftrl.fit(np.arange(0, 1001, 2), idx, np.ones(1000), np.stack([1 - y, y], 1).astype(float), 64, alpha=0.3, l1=3.0, l2=0.1)
    assert w[1, 1] > 0 > w[0, 1] and (w[2:, 1] != 0).sum() < 10


def test_leaks_with_a_token_in_every_document(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(500)]
    item = "start of the item one of the " + " ".join(rng.choice(words, 8))
    texts = ["one of the " + " ".join(rng.choice(words, 40)) + " one of the" for _ in range(300)]
    texts[7] += " " + item + " tail"
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, item), (3, "one of the")], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks.leak_report(d, items).collect()}
    assert all(got[k]["items"] == (["1", "2", "3"] if k == 7 else ["3"]) for k in range(300))
    assert got[3]["n_hit"] == 6 and got[7]["n_hit"] == 6 + len(item.split())


def test_names_with_dots(spark):
    d = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE)], "`doc.id` long, `the.text` string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert leaks.decontaminate(d, items, id_col="doc.id", text_col="the.text").count() == 0
    assert near.drop_near_duplicates(d, id_col="doc.id", text_col="the.text").count() == 1
    assert lines.dedup_lines(d, id_col="doc.id", text_col="the.text").count() == 2


@pytest.mark.parametrize(("percent", "want"), [(85, (25, 5)), (80, (32, 4)), (95, (12, 10)), (50, (64, 2))])
def test_bands_follow_the_threshold(percent, want):
    bands, rows = near.bands_of(percent)
    assert (bands, rows) == want or (1 - (percent / 100) ** rows) ** bands <= near.MISSED
    assert bands * rows <= near.SAMPLES


def test_vectors_of_several_lengths_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL", 8)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for dim, n in ((3, 150), (5, 90), (9, 1)):
        x = rng.normal(size=(n, dim))
        first = len(rows)
        rows += [(first + k, v.tolist()) for k, v in enumerate(x)]
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        link = y @ y.T >= 0.95
        np.fill_diagonal(link, False)
        comp = np.arange(n)
        for _ in range(n):
            comp = np.array([min([comp[k], *comp[link[k]]]) for k in range(n)])
        want |= {first + k: (int(link[k].sum()), first + int(comp[k])) for k in range(n)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["id"]: (r["n_links"], r["component"]) for r in vectors.near_duplicate_vectors(df).collect()} == want
    assert [vectors.cells_for(n) for n in (1, 100, 6400)] == [1, 10, 80]


def test_portions_bound_shingles(monkeypatch):
    monkeypatch.setattr(near, "SHINGLES", 10)
    sets = [np.arange(n) for n in (4, 4, 4, 30, 1, 1)]
    assert [p.tolist() for p in near._portions(np.arange(6), sets)] == [[0, 1], [2], [3], [4, 5]]
