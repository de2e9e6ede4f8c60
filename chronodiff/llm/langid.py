"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm import ftrl
from chronodiff.llm.tables import small_batches
from chronodiff.llm.textnum import chunks, segment_sum

#: Buckets of the hashed n-grams.
DIMS = 1 << 16
#: Lengths of the n-grams, in characters.
ORDERS = (1, 2, 3)
#: Labelled rows of each language that the fit uses, about; a language of fewer is used whole.
MAX_PER_LANGUAGE = 1500
#: Values are term frequencies times idf times this.
SCALE = 20.0
#: Bytes of text worked on at once (a character takes some sixty bytes meanwhile).
PART = 1 << 20
#: The answer where there is nothing to judge.
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, n-grams before each text, whether it has a letter.

    Texts are lower-cased; a run of characters that are no letters is one
    boundary, and n-grams that end in a boundary after another are left out.
    """
    low = [t.lower() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 0)
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before
    start = np.searchsorted(np.flatnonzero(keep), off)
    code, n = code[keep].astype(np.uint32), len(texts)
    any_letter = np.diff(start) > 0
    rows = np.repeat(np.arange(n), np.diff(start))
    first = np.arange(len(code)) - np.repeat(start[:-1], np.diff(start))
    out, total = np.zeros((len(code), len(ORDERS)), np.int64), np.zeros((len(code), len(ORDERS)), bool)
    h = np.zeros(len(code), np.uint32)
    for k, order in enumerate(ORDERS):
        back = np.zeros_like(code)
        back[order - 1 :] = code[: len(code) - order + 1]
        back[first < order - 1] = 0
        h = (h ^ (back + np.uint32(0x9E37 * order))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        out[:, k] = (h * np.uint32(0xC2B2AE35)) >> np.uint32(16)
        total[:, k] = code > 0 if order == 1 else True
    counts = np.bincount(rows, weights=total.sum(axis=1), minlength=n).astype(np.int64)
    return out[total], np.concatenate([[0], np.cumsum(counts)]), any_letter


def _texts(buf: np.ndarray, off: np.ndarray) -> list[str]:
    raw, ends = buf.tobytes(), off.tolist()
    return [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]


@dataclass
class Model:
    """Languages, and for each bucket idf times weights; biases; calibration temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated probability."""
        bucket, before, any_letter = _grams(texts)
        sums = np.stack([segment_sum(self.weights[bucket, k], before) for k in range(len(self.langs))], axis=1)
        logit = (sums * SCALE / np.maximum(np.diff(before), 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), any_letter.tolist(), strict=True)]
        return lang, np.where(any_letter, p[np.arange(len(best)), best], 0.0)


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all ``rows`` each bucket occurs, and how many rows there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0), PART):
                bucket, before, _ = _grams(_texts(buf, off))
                counts += np.bincount(ftrl.unique_buckets(before, bucket, DIMS)[1], minlength=DIMS)
                rows += len(off) - 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows))], ["bucket", "n"])

    got = rows.select(F.col(f"`{text_col}`")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(DIMS), 0
    for r in got:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, total


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """A model of the languages in ``rows``, all of which may be learned from.

    Document frequencies come from all the rows; weights from about
    ``max_per_language`` rows of each language, four fifths of them to fit (FTRL
    with elastic net) and the rest to choose the temperature, both weighted so
    that the languages keep their shares in all rows. Rows without text
    or language are left out; without any row there is no language to answer.
    """
    small_batches(rows.sparkSession)
    known = rows.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    df, total = document_frequencies(known, "text")
    if not total:
        return Model([UNKNOWN], np.zeros((DIMS, 1), np.float32), np.zeros(1))
    idf = np.log((total + 1) / (df + 1)) + 1

    def featurize(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bucket, before, _ = _grams(_texts(buf, off))
        indptr, idx, counts = ftrl.unique_buckets(before, bucket, DIMS)
        n = np.repeat(np.maximum(np.diff(before), 1), np.diff(indptr))
        return indptr, idx, counts / n * SCALE * idf[idx]

    sample, stand_for = ftrl.bounded_sample(known, "id", "lang", max_per_language)
    indptr, idx, val, lang = ftrl.sample_features(sample, "text", "lang", "id", featurize)
    langs = sorted(set(lang))
    y = np.array([langs.index(x) for x in lang])
    if len(langs) == 1:
        return Model(langs, np.zeros((DIMS, 1), np.float32), np.zeros(1))
    weight = ftrl.row_weights(lang, stand_for)
    target = np.eye(len(langs))[y]
    check = np.arange(len(y)) % 5 == 4
    fit_rows = np.flatnonzero(~check) if check.any() else np.arange(len(y))
    w, b = ftrl.fit(*_take(indptr, idx, val, fit_rows), target[fit_rows], DIMS, alpha=0.5, l1=0.05, l2=0.01, epochs=3, weight=weight[fit_rows])
    logits = _logits(*_take(indptr, idx, val, np.flatnonzero(check)), w, b)
    temperature = _calibrate(logits, y[check], weight[check])
    del indptr, idx, val
    ftrl.give_back()
    return Model(langs, (w * idf[:, None]).astype(np.float32), b, temperature)


def _take(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [slice(indptr[r], indptr[r + 1]) for r in rows]
    sizes = np.concatenate([[0], np.cumsum([p.stop - p.start for p in parts])]).astype(np.int64)
    return sizes, np.concatenate([*[idx[p] for p in parts], np.zeros(0, np.int64)]), np.concatenate([*[val[p] for p in parts], np.zeros(0)])


def _logits(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A column a language, one after the other, so that memory is that of one."""
    return np.stack([segment_sum(w[idx, k] * val, indptr) for k in range(w.shape[1])], axis=1) + b


def _calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least cross-entropy on rows that the fit has not seen.

    Targets are smoothed by one row of each language, so that a check without
    errors does not ask for certainty.
    """
    if not len(y):
        return 1.0

    smooth = logits.shape[1] / (len(y) + logits.shape[1])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-np.average((1 - smooth) * z[np.arange(len(y)), y] + smooth * z.mean(axis=1), weights=weight))

    return float(min(np.geomspace(0.05, 200, 161), key=loss))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (calibrated probability) of every whole text; no shuffle.

    Defined cases: null, empty and letterless texts give ``und`` with score 0;
    ties go to the language that sorts first; repeated rows are judged each;
    other columns are not read; a very long text is judged whole, with some 100
    bytes of memory a byte of it in its task, however many languages there are;
    an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1), PART):
                lang, p = shared.value.predict(_texts(buf, off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(p)], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
