"""Token alignment, against the tokenizers' own libraries on whole texts and plain loops."""

import bisect
import hashlib
import itertools
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronodiff.llm import queries as q
from chronodiff.llm import tokalign
from chronodiff.llm.bpe import codec

LONG = " ".join(f"word{k % 997} {k}" for k in range(30_000))
TEXTS = [
    None, "", " ", "\n", "one", " lead", "trail  ", "two  spaces   three", "a\n  b\n\n\tc \n d  e", "漢字 é ñ ß ﬁ é ①", "x▁y", "<s> </s> <|endoftext|> <0x0A> <unk>",
    "=" * 3000, " " * 777 + "end", "\x00\x01 odd \x1c \x1d\x85 z", "ab​  c", "🙂🙂 👩‍👩‍👧", LONG, LONG, "tie tie tie.", "tie tie tie.", "don't they're I'LL 12345678 --- ...",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    own = Tokenizer.from_file(q.vocab_file())
    own.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=q.piece_file())
    names = codec(q.vocab_file()).token

    def piece_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        a, b = own.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        return [(i, names[i]) for i in a], [(i, piece_bytes(i)) for i in b]

    return both


def groups_of(text, sides):
    """[(a ids, b ids)] of a text; none where it has no tokens."""
    if not text:
        return []
    a, b = sides(text)
    want = (" " + text).encode()
    if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
        return []
    ends = [set(itertools.accumulate(len(t) for _, t in side)) for side in (a, b)]
    cuts, out = sorted(ends[0] & ends[1]), []
    for side in (a, b):
        at, parts = 0, defaultdict(list)
        for i, t in side:
            at += len(t)
            parts[cuts[bisect.bisect_left(cuts, at)]].append(i)
        out.append(parts)
    return [(out[0][c], out[1][c]) for c in cuts]


def brute(docs, sides):
    found = [(doc, groups_of(text, sides)) for doc, text in docs]
    docs_of = Counter(p for _, gs in found for p in {(a, b) for x, y in gs for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in docs_of.items():
        top[a] = max(top[a], n)
    out = []
    for doc, gs in found:
        links = Counter()
        for x, y in gs:
            for (a, m), (b, n) in itertools.product(Counter(x).items(), Counter(y).items()):
                links[a, b] += m * n
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        best = sum(n for p, n in links.items() if docs_of[p] == top[p[0]])
        out.append((doc, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(links.values()), best, sum(n * docs_of[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows.collect()), key=repr)


def test_whole_table(spark, sf_dir, sides):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(q.op12_token_alignment(spark, sf_dir)) == brute(docs, sides)


@pytest.mark.parametrize("limit", [tokalign.BROADCAST_PAIRS, 0])
def test_odd_texts(spark, sides, limit, monkeypatch):
    monkeypatch.setattr(tokalign, "BROADCAST_PAIRS", limit)
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "same id"), (3, "same id"), (None, "no id")]
    frame = spark.createDataFrame([(*d, "x", 1, None) for d in docs], "doc_id long, text string, id string, row int, pairs string")
    files = q.vocab_file(), q.piece_file()
    assert got(tokalign.align_corpus(frame, *files)) == brute(docs, sides)
    assert tokalign.align_corpus(frame.limit(0), *files).count() == 0


def test_spans(spark, sides):
    docs = [(k, t) for k, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tokalign.align(frame, q.vocab_file(), q.piece_file(), spans=True).collect()}
    for k, text in docs:
        r, gs = rows[k], groups_of(text, sides)
        assert r["groups"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        if gs and len(text) < 5000:
            spans = [[(e - len(t), e) for (_, t), e in zip(side, itertools.accumulate(len(t) for _, t in side), strict=True)] for side in sides(text)]
            want = {(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if a < d and c < b}
            assert set(zip(r["overlap_a"], r["overlap_b"], strict=True)) == want
