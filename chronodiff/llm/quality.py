"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm import ftrl
from chronodiff.llm.tables import small_batches
from chronodiff.llm.textnum import LETTERS, NOT_SPACE, chunks, hash_spans, mix, ngrams, segment_sum, spans

#: Buckets of the hashed features.
DIMS = 1 << 18
#: Labelled rows of each class that the fit uses, about; a class of fewer is used whole.
MAX_PER_CLASS = 4000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = NOT_SPACE & ~LETTERS
_DIGITS = np.arange(48, 58)
_PUNCT[_DIGITS] = False


@dataclass
class Model:
    """Weights by bucket, and the bias."""

    weights: np.ndarray
    bias: float


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text: white-space words, their shapes and their marks, as n-grams.

    Three rows of words: the words in lower case; what each looks like (length
    class, all capitals, marks at the end, same as the word before); and the
    runs of marks. One- and two-word grams of the first two, one-mark grams.
    """
    starts, ends, before = spans(buf, off, NOT_SPACE)
    words = hash_spans(buf, starts, ends)
    size = np.minimum(ends - starts, 24).astype(np.uint64)
    if len(starts):
        edges = np.stack([starts, ends], 1).ravel()
        upper = np.add.reduceat(np.append(_UPPER[buf].astype(np.int32), 0), edges)[::2]
        marks = np.add.reduceat(np.append(_PUNCT[buf].astype(np.int32), 0), edges)[::2]
        letters = np.add.reduceat(np.append(LETTERS[buf].astype(np.int32), 0), edges)[::2]
    else:
        upper = marks = letters = np.zeros(0, np.int64)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[before[:-1][before[:-1] < len(words)]] = False
    caps = ((upper >= 2) & (upper == letters)).astype(np.uint64)
    shape = mix((size // np.uint64(4)) + np.uint64(16) * caps + np.uint64(32) * np.minimum(marks, 4).astype(np.uint64) + np.uint64(256) * same.astype(np.uint64) + np.uint64(1 << 20))
    m_starts, m_ends, m_before = spans(buf, off, _PUNCT)
    rows = [(words, before), ngrams(words, before, 2), (shape, before), ngrams(shape, before, 2), (hash_spans(buf, m_starts, m_ends) ^ np.uint64(0x55), m_before)]
    n = len(off) - 1
    counts = np.stack([np.diff(b) for _, b in rows])
    total = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out = np.empty(int(total[-1]), np.uint64)
    place = total[:-1].copy()
    for (h, b), c in zip(rows, counts, strict=True):
        out[np.arange(len(h)) + np.repeat(place - b[:-1], c)] = h
        place += c
    assert len(total) == n + 1
    return out, total


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of each text: hashed n-grams with the root of their share of the text."""
    h, before = _tokens(buf, off)
    indptr, idx, counts = ftrl.unique_buckets(before, (h % np.uint64(DIMS)).astype(np.int64), DIMS)
    total = np.repeat(np.maximum(np.diff(before), 1), np.diff(indptr))
    return indptr, idx, np.sqrt(counts / total)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS) -> Model:
    """A model of ``label_col`` (0 or 1) from at most about ``max_per_class`` labelled rows of each class,
    weighted so that the classes keep their shares in all labels.

    ``labels`` are the rows that may be learned from. Rows without label or
    text are left out. Without rows of both classes the model gives every text
    the share of the class there is, or 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen, stand_for = ftrl.bounded_sample(known, "id", "y", max_per_class)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    indptr, idx, val, y = ftrl.sample_features(rows.join(F.broadcast(chosen), "id"), "text", "y", "id", features)
    if len(set(y)) < 2:
        return Model(np.zeros(DIMS, np.float32), 0.0 if not y else (4.0 if y[0] else -4.0))
    weight, y = ftrl.row_weights(y, stand_for), np.array(y)
    w, b = ftrl.fit(indptr, idx, val, np.stack([1 - y, y], 1).astype(float), DIMS, alpha=0.5, l1=0.3, l2=0.05, epochs=6, weight=weight)
    del indptr, idx, val
    ftrl.give_back()
    return Model(w[:, 1].copy(), float(b[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every whole text; no shuffle.

    Defined cases: null counts as the empty text, which gets the score of the
    bias alone; repeated rows are scored each, and equal texts alike, so that
    ties stay ties; other columns, whatever their names, are not read; a very long text is scored whole, with some 150 bytes
    of memory a byte of it in its task; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                indptr, idx, val = features(buf, off)
                logit = segment_sum(own.weights[idx] * val, indptr) + own.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-logit)))], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, score double").withColumnRenamed("id", id_col)
