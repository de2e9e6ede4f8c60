"""Follow-the-regularised-leader for sparse linear models, and bounded training samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A function of (bytes, offsets) that gives CSR features: offsets, buckets, values.
Featurizer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def unique_buckets(row_before: np.ndarray, bucket: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of distinct buckets of each row: offsets, buckets, counts."""
    rows = np.repeat(np.arange(len(row_before) - 1, dtype=np.int64), np.diff(row_before))
    key = np.sort(rows * dims + bucket)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(key)))
    key = key[head]
    return np.searchsorted(key, np.arange(len(row_before)) * dims), key % dims, counts


def fit(indptr: np.ndarray, idx: np.ndarray, val: np.ndarray, target: np.ndarray, dims: int, *, alpha: float, l1: float,
        l2: float, beta: float = 1.0, epochs: int = 3, seed: int = 7, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims, classes) and biases of a softmax model, one row at a time.

    FTRL-proximal with its own learning rate for each coordinate and an elastic
    net (``l1``, ``l2``); a weight whose sum of gradients stays within ``l1``
    is exactly 0. ``target`` holds class probabilities, (rows, classes). Two
    classes are a logistic regression: the first column is held at 0. A row of
    ``weight`` 2 counts as two.
    """
    n, classes = target.shape
    free = slice(1, None) if classes == 2 else slice(None)
    width = 1 if classes == 2 else classes
    z, s = np.zeros((dims, width)), np.zeros((dims, width))
    bz, bs = np.zeros(width), np.zeros(width)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(n):
            i, x = idx[indptr[r] : indptr[r + 1]], val[indptr[r] : indptr[r + 1], None]
            zi, si = z[i], s[i]
            root = np.sqrt(si)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0.0)
            b = -bz / ((beta + np.sqrt(bs)) / alpha)
            logit = (x * w).sum(axis=0) + b
            full = np.concatenate([[0.0], logit]) if classes == 2 else logit
            p = np.exp(full - full.max())
            error = (p / p.sum() - target[r])[free] * (1.0 if weight is None else weight[r])
            g = x * error
            z[i] = zi + g - (np.sqrt(si + g * g) - root) / alpha * w
            s[i] = si + g * g
            bz += error - (np.sqrt(bs + error * error) - np.sqrt(bs)) / alpha * b
            bs += error * error
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2), 0.0)
    b = -bz / ((beta + np.sqrt(bs)) / alpha)
    if classes == 2:
        w, b = np.concatenate([np.zeros_like(w), w], axis=1), np.concatenate([[0.0], b])
    return w.astype(np.float32), b


def crc_bucket(id_col: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class: those whose hashed id falls below the class's share.

    A class of fewer rows is taken whole. The choice depends on the ids alone.
    Also how many of its class a row stands for: all rows by expected sample.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    if not counts:
        return rows, {}
    share = F.coalesce(*[F.when(F.col(class_col).eqNullSafe(F.lit(k)), F.lit(min(1.0, per_class / n))) for k, n in counts.items()])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    return rows.where(draw < share), {k: max(1.0, n / per_class) for k, n in counts.items()}


def row_weights(classes: list, stand_for: dict) -> np.ndarray:
    """Weights that give a bounded sample the class shares of all rows; 1 in the class that is sampled least."""
    w = np.array([stand_for[k] for k in classes], float)
    return w / min(stand_for.values(), default=1.0)


def give_back() -> None:
    """Hand memory that a fit has freed back to the system: the driver's share is small, and both allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sample_features(rows: DataFrame, text_col: str, label_col: str, id_col: str, featurize, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """CSR features and labels of a bounded sample; texts are turned into features on the executors.

    Rows come in the order of their hashed ids (equal ids by text), whatever
    the files' layout, so that a fit to them is the same. Features are buckets
    of less than 2 ** 31, or whole hashes if ``wide``.
    """
    number = pa.int64() if wide else pa.int32()
    kind = rows.schema[label_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronodiff.llm.textnum import chunks

        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                indptr, idx, val = featurize(buf, off)
                lists = [pa.LargeListArray.from_arrays(pa.array(indptr, pa.int64()), pa.array(v)).cast(pa.list_(t)) for v, t in ((idx.astype(np.int64 if wide else np.int32), number), (val.astype(np.float32), pa.float32()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(lo, hi - lo) for k in (0, 2, 3)], *lists], ["label", "a", "b", "idx", "val"])

    text = F.col(f"`{text_col}`")
    got = rows.select(F.col(f"`{label_col}`").alias("label"), text.alias("text"), F.xxhash64(F.lit("order"), F.col(f"`{id_col}`")).alias("a"), F.xxhash64(text).alias("b"))
    got = got.mapInArrow(work, f"label {kind}, a long, b long, idx array<{'long' if wide else 'int'}>, val array<float>").toArrow()
    if not len(got):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), []
    got = got.sort_by([("a", "ascending"), ("b", "ascending")])
    flat = [got.column(c).combine_chunks() for c in ("idx", "val")]
    got = got.select(["label"])
    sizes = np.array(flat[0].value_lengths())
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    idx, val = (x.flatten().to_numpy() for x in flat)
    give_back()
    return indptr, idx, val, got.column("label").to_pylist()
