"""Toxicity by weak supervision: many small voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm import ftrl
from chronodiff.llm.tables import cut, small_batches
from chronodiff.llm.textnum import LETTERS, byte_class, chunks, hash_spans, hash_word, segment_sum, spans

#: Buckets of the hashed words.
DIMS = 1 << 18
#: Labelled rows of each class that lexicons and label model are fitted on, and documents of either posterior that the classifier is, about.
MAX_PER_CLASS = 2500
#: Bytes of the stems that count beside whole words.
STEMS = (4, 5, 6, 7)
#: Learned lexicons: the kinds of terms of each (0: words, then stems by length), and the half of the labelled rows it learns from.
LEXICONS = (((0,), 0), ((0,), 1), ((1, 2), 0), ((3, 4), 1))
#: Terms of a learned lexicon at most.
LEXICON_WORDS = 60
#: Pairs of voters whose correlation the label model keeps.
PAIRS = 8

#: Insults that one voter looks for besides the learned lexicons (fixed values).
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "bastard", "bitch", "asshole", "retard", "vermin")

_UPPER = byte_class(range(65, 91))
_BANG = byte_class([0x21, 0x3F])
_JUNK = byte_class([0x23, 0x24, 0x25, 0x26, 0x2A, 0x40])
VOTERS = len(LEXICONS) + 6
#: The low bits of a term's hash tell its kind.
_KIND = np.uint64(7)


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their stems, terms before each text, and words in each text.

    Words are runs of letters, A-Z lower-cased; a word of more than 4 to 7
    bytes also gives its first 4 to 7 bytes, as insults are bent by endings.
    """
    starts, ends, before = spans(buf, off, LETTERS)
    size = ends - starts
    table = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    table[:, 0] = hash_spans(buf, starts, ends) & ~_KIND
    for k, n in enumerate(STEMS, 1):
        longer = size > n
        table[longer, k] = hash_spans(buf, starts[longer], starts[longer] + n) & ~_KIND | np.uint64(k)
    there = table != 0
    count = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return table[there], count[before], np.diff(before)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(3)) % np.uint64(DIMS)).astype(np.int64)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of each text: hashed words and stems by bucket, with the logarithm of their counts."""
    h, before, _ = terms(buf, off)
    indptr, idx, counts = ftrl.unique_buckets(before, _bucket(h), DIMS)
    return indptr, idx, np.log1p(counts)


def whole_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of each text: its distinct words and stems by whole hash, for a bounded sample."""
    h, before, _ = terms(buf, off)
    own = [np.unique(h[a:b], return_counts=True) for a, b in zip(before[:-1], before[1:], strict=True)]
    idx = np.concatenate([*[x for x, _ in own], np.zeros(0, np.uint64)])
    counts = np.concatenate([*[c for _, c in own], np.zeros(0, np.int64)])
    return np.concatenate([[0], np.cumsum([len(x) for x, _ in own])]).astype(np.int64), idx.view(np.int64), np.log1p(counts)


@dataclass
class Lexicons:
    """Hashed terms in order, and a bit for each voter that a term belongs to."""

    words: np.ndarray
    voters: np.ndarray

    def votes(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One bit for each voter that fires, for every text.

        Learned lexicons; the fixed insults; two words of any lexicon or more;
        such a word in every fifty; shouting (mostly capitals); strings of !
        and ?; strings of symbols.
        """
        h, before, n = terms(buf, off)
        bits = np.zeros(len(n), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        hit = self.words[at] == h if len(self.words) and len(h) else np.zeros(len(h), bool)
        spot = np.flatnonzero(hit)
        row = np.searchsorted(before, spot, "right") - 1
        np.bitwise_or.at(bits, row, self.voters[at[spot]])
        hits = np.bincount(row[h[spot] & _KIND == 0], minlength=len(n))
        size = np.maximum(np.diff(off), 1)

        def share(table: np.ndarray) -> np.ndarray:
            return segment_sum(table[buf].astype(np.float64), off) / size

        fired = [hits >= 2, hits * 50 >= np.maximum(n, 1), share(_UPPER) > 0.5, share(_BANG) > 0.02, share(_JUNK) > 0.05]
        for k, x in enumerate(fired):
            bits |= x.astype(np.int64) << np.int64(len(LEXICONS) + 1 + k)
        return bits


def learn_lexicons(indptr: np.ndarray, idx: np.ndarray, y: np.ndarray, half: np.ndarray) -> Lexicons:
    """For each learned lexicon the terms of its kinds that speak most for toxic texts in its half of the rows, by smoothed log odds of presence."""
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    h = idx.view(np.uint64)
    bits: dict[int, int] = {}
    for k, (kinds, own) in enumerate(LEXICONS):
        mine = (half[row] == own) & np.isin(h & _KIND, np.array(kinds, np.uint64))
        word, at = np.unique(h[mine], return_inverse=True)
        toxic = np.bincount(at, weights=y[row[mine]], minlength=len(word))
        clean = np.bincount(at, weights=1 - y[row[mine]], minlength=len(word))
        n1, n0 = max(y[half == own].sum(), 1), max((1 - y[half == own]).sum(), 1)
        odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
        best = np.flatnonzero((toxic >= max(3, 0.01 * n1)) & (odds > 2.0))
        for w in word[best[np.argsort(-odds[best] * np.sqrt(toxic[best]), kind="stable")][:LEXICON_WORDS]].tolist():
            bits[w] = bits.get(w, 0) | 1 << k
    for insult in INSULTS:
        w = hash_word(insult) & ~int(_KIND)
        bits[w] = bits.get(w, 0) | 1 << len(LEXICONS)
    known = np.array(sorted(bits), np.uint64)
    return Lexicons(known, np.array([bits[int(w)] for w in known], np.int64))


@dataclass
class LabelModel:
    """p(toxic), and for each class the voters' rates with shared pair terms, over all vote patterns."""

    posterior: np.ndarray
    accuracy: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)


def fit_label_model(unlabelled: np.ndarray, gold: np.ndarray, voters: int = VOTERS, steps: int = 1500) -> LabelModel:
    """A generative model of votes by gradient ascent on the likelihood of all counted patterns.

    ``unlabelled`` counts the patterns of documents without a usable label,
    ``gold`` (patterns, 2) those with one. p(votes | class) is a log-linear
    model: one term for each voter and class (its accuracy), and a term shared
    by the classes for the pairs that the labelled rows show to be most
    correlated within a class.
    """
    size = 1 << voters
    bits = ((np.arange(size)[:, None] >> np.arange(voters)) & 1).astype(float)
    held = gold.sum(axis=0)
    spread = np.zeros((voters, voters))
    for y in (0, 1):
        p = gold[:, y] / max(held[y], 1)
        mean = p @ bits
        cov = (bits * p[:, None]).T @ bits - np.outer(mean, mean)
        spread += np.abs(cov) / np.sqrt(np.outer(mean * (1 - mean), mean * (1 - mean)) + 1e-3)
    upper = [(i, j) for i in range(voters) for j in range(i + 1, voters)]
    pairs = [p for p in sorted(upper, key=lambda p: -spread[p])[:PAIRS] if spread[p] > 0.05]
    design = np.concatenate([bits, *[bits[:, i : i + 1] * bits[:, j : j + 1] for i, j in pairs]], axis=1)
    rates = (gold.T @ bits + 0.5) / (held[:, None] + 1)
    theta = np.concatenate([np.log(rates / (1 - rates)), np.zeros((2, len(pairs)))], axis=1)
    prior = np.log((held + 0.5) / (held.sum() + 1))
    total = max(unlabelled.sum() + gold.sum(), 1)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        joint = design @ theta.T
        norm = np.log(np.exp(joint - joint.max(axis=0)).sum(axis=0)) + joint.max(axis=0)
        given = joint - norm
        both = given + prior
        post = 1 / (1 + np.exp(np.clip(both[:, ::-1] - both, -60, 60)))
        count = unlabelled[:, None] * post + gold
        n = count.sum(axis=0)
        grad = (design.T @ (count - n * np.exp(given))).T - 0.5 * np.tanh(theta)
        grad[:, voters:] = grad[:, voters:].sum(axis=0)
        grad /= total
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        prior = np.log((n + 0.5) / (n.sum() + 1))
    return LabelModel(post[:, 1], theta[1, :voters] - theta[0, :voters], pairs)


@dataclass
class Model:
    """Weights by bucket, bias, and the label model that they were trained on."""

    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None


def count_patterns(docs: DataFrame, lexicons: Lexicons, text_col: str) -> np.ndarray:
    """How many of all documents have each vote pattern; at most 2 ** VOTERS counts reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << VOTERS, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                counts += np.bincount(shared.value.votes(buf, off), minlength=1 << VOTERS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pattern", "n"])

    got = docs.select(F.col(f"`{text_col}`")).mapInArrow(work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << VOTERS)
    for r in got.collect():
        out[r["pattern"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Lexicons, label model and classifier.

    ``labels`` are the rows that may be learned from (0 or 1; others are left
    out), of which about ``max_per_class`` of each class are used, weighted so that
    the classes keep their shares in all labels. They give the lexicons, and
    anchor the label model, which is fitted to the counted votes of all
    documents. The classifier sees no label: it is fitted to about
    ``max_per_class`` documents of either posterior, labelled or not, whose
    targets are the posteriors of their votes. Without rows of both classes the
    score is a constant.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen, stand_for = ftrl.bounded_sample(known, "id", "y", max_per_class)
    label = {r["id"]: r["y"] for r in chosen.collect()}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    labelled = rows.join(F.broadcast(chosen.select("id")), "id")  # bounded by max_per_class
    indptr, idx, _, ids = ftrl.sample_features(labelled, "text", "id", "id", whole_hashes, wide=True)
    y = np.array([label[i] for i in ids], float)
    if len(set(label.values())) < 2 or not 0 < y.sum() < len(y):
        return Model(np.zeros(DIMS, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    half = np.array([zlib.crc32(str(i).encode()) & 1 for i in ids])
    lexicons = learn_lexicons(indptr, idx, y, half)
    del indptr, idx
    ftrl.give_back()
    pattern = dict(zip(*_sample_votes(labelled, lexicons), strict=True))
    votes = np.array([pattern[i] for i in ids])
    whole = np.where(y > 0, stand_for[1], stand_for[0])
    gold = np.stack([np.bincount(votes, weights=w * whole, minlength=1 << VOTERS) for w in (1 - y, y)], axis=1)
    counts = count_patterns(docs, lexicons, text_col)
    label_model = fit_label_model(np.maximum(counts - gold.sum(axis=1), 0), gold)
    post = label_model.posterior
    n = [counts[post < 0.5].sum(), counts[post >= 0.5].sum()]
    # written, so that no task has two Python workers at once
    drawn = cut(_drawn(rows, lexicons, post, [min(1.0, max_per_class / max(k, 1)) for k in n]), "drawn")
    indptr, bucket, val, target = ftrl.sample_features(drawn, "text", "target", "id", features)
    target = np.array(target)
    weight = ftrl.row_weights((target >= 0.5).astype(int).tolist(), {k: max(1.0, n[k] / max_per_class) for k in (0, 1)})
    w, b = ftrl.fit(indptr, bucket, val, np.stack([1 - target, target], 1), DIMS, alpha=0.3, l1=3.0, l2=0.1, epochs=5, weight=weight)
    del indptr, bucket, val
    ftrl.give_back()
    return Model(w[:, 1].copy(), float(b[1]), label_model)


def _drawn(rows: DataFrame, lexicons: Lexicons, posterior: np.ndarray, share: list[float]) -> DataFrame:
    """``id``, ``text`` and ``target`` (posterior) of the share of documents of either posterior; the draw depends on ids alone."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicons, posterior))
    draw = F.pmod(F.xxhash64(F.lit("posterior"), "id"), F.lit(1_000_003)) / 1_000_003
    few = rows.select("id", "text", draw.alias("draw")).where(F.col("draw") < max(share))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, post = shared.value
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                target = post[own.votes(buf, off)]
                keep = pa.array(batch.column(2).slice(lo, hi - lo).to_numpy() < np.where(target >= 0.5, share[1], share[0]))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo).filter(keep) for k in (0, 1)], pa.array(target).filter(keep)], ["id", "text", "target"])

    kind = rows.schema["id"].dataType.simpleString()
    return few.mapInArrow(work, f"id {kind}, text string, target double")


def _sample_votes(rows: DataFrame, lexicons: Lexicons) -> tuple[list, list]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lexicons.votes(buf, off))], ["id", "pattern"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", "text").mapInArrow(work, f"id {kind}, pattern long").collect()
    return [r["id"] for r in got], [r["pattern"] for r in got]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, higher: toxic likelier) of every whole text; no shuffle.

    Defined cases: null counts as the empty text, which gets the score of the
    bias alone; repeated rows are scored each, and equal texts alike, so that
    ties stay ties; other columns, whatever their names, are not read; a very long text is scored whole, with some 150 bytes
    of memory a byte of it in its task; an empty table stays empty.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(docs, model, 1), f"id {kind}, score double").withColumnRenamed("id", id_col)


def _scorer(docs: DataFrame, model: Model, text_at: int):
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(text_at)):
                indptr, idx, val = features(buf, off)
                logit = segment_sum(weights[idx] * val, indptr) + bias
                own = batch.slice(lo, hi - lo)
                kept = own.columns if text_at == 0 else own.columns[:1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-logit)))], [f"c{k}" for k in range(len(kept))] + ["score"])

    return work


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; columns as they come, no shuffle.

    Cases as in ``score``; a model without labelled rows of both classes, whose
    score is a constant, rejects nothing; all columns pass through the scoring task.
    """
    if model.label_model is None:
        return docs
    order = [text_col, *[c for c in docs.columns if c != text_col]]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(order)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    kept = rows.mapInArrow(_scorer(docs, model, 0), schema).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{order.index(c)}").alias(c) for c in docs.columns])
