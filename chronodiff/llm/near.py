"""Near-duplicate texts: banded MinHash, odd sketches to judge candidates, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import components, cut, small_batches
from chronodiff.llm.textnum import NOT_SPACE, chunks, hash_spans, mix, ngrams, spans

#: MinHash samples of a set.
SAMPLES = 128
#: How often a pair at the threshold may share no band.
MISSED = 1e-6
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: How far below the threshold an odd sketch must see a pair to dismiss it. An estimate at 0.8 or more has a
#: standard error of 0.035 to 0.041 (samples and bits together), so this is some five of them: once in 3.5 million.
SLACK = 0.2
#: Rows of a bucket, and shingles of them, that one task compares with others at once.
BLOCK, SHINGLES = 512, 1 << 18
#: Up to so many document ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(1, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _RNG.integers(1, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, samples of each) for a threshold: bands as long as let a pair at it share none once in ``1 / MISSED`` times at most.

    0.85: 25 of 5, once in 2.3 million; 0.80: 32 of 4, once in 21 million.
    """
    for rows in range(SAMPLES, 1, -1):
        bands = SAMPLES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    return SAMPLES, 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; a shorter text is one run."""
    starts, ends, before = spans(buf, off, NOT_SPACE)
    h = hash_spans(buf, starts, ends)
    grams, g_before = ngrams(h, before, size)
    n, g_ends = np.diff(before), g_before.tolist()
    out = [np.unique(grams[a:b]) for a, b in zip(g_ends, g_ends[1:], strict=False)]
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        whole = np.array([n[k]], np.uint64)
        for at in range(before[k], before[k + 1]):
            whole = mix(whole * np.uint64(0xA24BAED4963EE407) + h[at : at + 1])
        out[k] = whole
    return out


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of sets that are not empty."""
    flat = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(sets), bands), np.uint64)
    sketch = np.zeros((len(sets), SKETCH_BITS // 64), np.uint64)
    row = np.arange(len(sets))
    for j in range(SAMPLES):
        v = (low ^ _XOR[j]) * _MUL[j]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(v, heads).astype(np.uint64)
        spot = mix(least + np.uint64((j + 1) << 32)) % np.uint64(SKETCH_BITS)
        sketch[row, (spot >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (spot & np.uint64(63))
        if j < bands * rows:
            keys[:, j // rows] = mix(keys[:, j // rows] * np.uint64(31) + least + np.uint64(j))
    return keys, sketch


def _sign(size: int, percent: int):
    """Size, SHA-256 and band keys of each text's set."""
    bands, length = bands_of(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                sets = shingle_sets(buf, off, size)
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((len(n), bands), np.uint64)
                if n.any():
                    keys[n > 0] = _signatures([s for s in sets if len(s)], bands, length)[0]
                listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                digest = pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), digest, listed], ["id", "n_shingles", "digest", "bands"])

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                sets = shingle_sets(buf, off, size)
                some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                if len(some):
                    own = [sets[k] for k in some]
                    cols = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (own, _signatures(own, 1, 1)[1])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), *cols], ["id", "shingles", "sketch"])

    return work


def _limit(similarity: float) -> int:
    """Most bits in which the sketches of a pair at this similarity differ, with slack."""
    apart = 2 * SAMPLES * (1 - max(similarity - SLACK, 0.0))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** apart)))


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], l_sketch: np.ndarray, r_sketch: np.ndarray, may: np.ndarray, percent: int) -> np.ndarray:
    """Which (left, right) pairs of sets have 100 * intersection >= percent * union, among those in ``may``.

    Odd sketches dismiss pairs that are far apart; the others' intersections
    are exact: counted one by one where they are few, as products of 0/1
    matrices over the shingles that occur in several sets where they are many.
    """
    n_l, n_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    small, large = np.minimum.outer(n_l, n_r), np.maximum.outer(n_l, n_r)
    may = may & (100 * small >= percent * large)
    far = np.zeros(may.shape, np.int64)
    for w in range(l_sketch.shape[1]):
        far += np.bitwise_count(l_sketch[:, w][:, None] ^ r_sketch[:, w][None, :])
    may &= far <= _limit(percent / 100)
    need = np.zeros(may.shape, bool)
    pairs = np.argwhere(may)
    if len(pairs) <= 2 * (len(left) + len(right)):
        for i, j in pairs.tolist():
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            need[i, j] = 100 * both >= percent * (n_l[i] + n_r[j] - both)
        return need
    word, at, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    order = np.full(len(word), -1)
    order[count > 1] = np.arange(int((count > 1).sum()))
    column = order[at]
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate([n_l, n_r]))
    inter = np.zeros(may.shape)
    for lo in range(0, int((count > 1).sum()), 4096):
        here = (column >= lo) & (column < lo + 4096)
        table = np.zeros((len(left) + len(right), 4096), np.float32)
        table[row[here], column[here] - lo] = 1
        inter += table[: len(left)] @ table[len(left) :].T
    return may & (100 * inter >= percent * (np.add.outer(n_l, n_r) - inter))


def _forest(ids: list, others: list, links: np.ndarray, parent: dict) -> list[tuple]:
    """Links that join two trees of ``parent``; the others change no component."""
    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    out = []
    for i, j in np.argwhere(links).tolist():
        a, b = root(ids[i]), root(others[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], others[j]))
    return out


def _portions(rows: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of rows of at most ``BLOCK`` sets and ``SHINGLES`` shingles, or of one larger set."""
    out, first, held = [], 0, 0
    for k, r in enumerate(rows.tolist()):
        if k > first and (k - first >= BLOCK or held + len(sets[r]) > SHINGLES):
            out.append(rows[first:k])
            first, held = k, 0
        held += len(sets[r])
    return [*out, rows[first:]]


def _compare(percent: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        marks = np.array([np.frombuffer(s, np.uint64) for s in group["sketch"]])
        ids, comp, right = group["id"].tolist(), group["comp"].to_numpy(), group["right"].to_numpy()
        own, other = np.flatnonzero(~right), np.flatnonzero(right)
        other = other if len(other) else own
        edges, parent = [], {}
        for i in _portions(own, sets):
            for j in _portions(other, sets):
                links = linked_pairs([sets[k] for k in i], [sets[k] for k in j], marks[i], marks[j], comp[i][:, None] != comp[j][None, :], percent)
                edges += _forest([ids[k] for k in i], [ids[k] for k in j], links, parent)
        return pd.DataFrame(edges, columns=["a", "b"])

    return work


def _compared(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the left and right rows of each block (``k1``, ``k2``, ``k3``); among the left rows if there are no right ones."""
    kind = blocks.schema["id"].dataType.simpleString()
    rows = blocks.join(sets, "id")
    return rows.groupBy("k1", "k2", "k3").applyInPandas(_compare(percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``id``, ``n_shingles``, ``component`` of every row; documents of a component are near-duplicates.

    A document's set holds its distinct shingles of ``size`` words (white-space
    words, A-Z lower-cased; fewer words are one shingle). Two documents are
    linked if 100 * intersection >= ``percent`` * union; a component is named
    by the smallest id that links reach.

    1. Every text is signed once: SHA-256 of the full sorted set, band keys.
       Documents with equal sets are one from here on.
    2. Documents that share a band key meet in a bucket. Each is compared with
       the smallest of the bucket, in blocks; links give first components.
    3. In a bucket that still holds several components, every document outside
       the component of the smallest one is compared with all documents, block
       by block of both. So every pair that shares a bucket is either in one component
       already or compared; no pair list is written.

    A comparison estimates the similarity by odd sketches and confirms it on
    the full sets. A group holds about two blocks at most, whatever the
    bucket's size.

    Defined cases: null, empty and blank texts have an empty set and are linked
    with nothing; a row without id is linked with nothing and its component is
    null; rows that share an id are one document; a pair exactly at the
    threshold is linked; a very long text is one set in its task, 8 bytes a
    shingle and some 60 a byte while it is made; an empty table stays empty;
    other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = cut(rows.mapInArrow(_sign(size, percent), f"id {kind}, n_shingles long, digest binary, bands array<long>"), "signed")
    used = signed.where("n_shingles > 0 and id is not null")
    same = cut(used.groupBy("digest", "n_shingles").agg(F.min("id").alias("rep")), "same")
    single = same.select(F.col("rep").alias("id"), "digest")
    reps = used.join(single, ["id", "digest"], "left_semi")

    keyed = reps.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead")
    members = cut(keyed.join(buckets, "key").distinct(), "members")
    wanted = cut(members.select("id").distinct(), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    sets = cut(texts.mapInArrow(_sets(size), f"id {kind}, shingles binary, sketch binary"), "sets")

    pairs = members.where("id <> lead").select("lead", "id").distinct()
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    heads = sizes.select(F.col("lead").alias("k1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k2"), F.col("lead").alias("id"), F.lit(True).alias("right"))
    tails = pairs.join(sizes, "lead").select(F.col("lead").alias("k1"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("k2"), "id", F.lit(False).alias("right"))
    first = cut(_compared(heads.unionByName(tails).withColumn("comp", F.col("id")).withColumn("k3", F.lit(0)), sets, percent), "links")

    comps = components(first)
    placed = cut(
        members.join(comps, members["id"] == comps["node"], "left").select("key", "lead", "id", F.coalesce("component", "id").alias("comp")), "placed"
    )
    split = placed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("s"), F.min_by("comp", "id").alias("main")
    ).where("low <> high")
    split = split.groupBy("x", "s", "n").agg(F.min("key").alias("key"), F.min_by("main", "key").alias("main"))
    mixed = placed.join(split.select("key", "main"), "key").withColumn("minor", F.col("comp") != F.col("main"))
    parts = mixed.groupBy("key").agg(*[F.ceil(F.count(F.when(F.col("minor") == x, 1)) / BLOCK).cast("int").alias(c) for c, x in (("p", False), ("q", True))])
    mixed = mixed.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("q")).otherwise(F.col("p"))).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("o")
    base = ["key", "id", "comp", "own"]
    home = mixed.where("not minor").select(*base, upto("q")).select("key", "id", "comp", F.col("own").alias("i"), F.col("o").alias("j"), F.lit(False).alias("right"))
    minor = mixed.where("minor and p > 0").select(*base, upto("p")).select("key", "id", "comp", F.col("o").alias("i"), F.col("own").alias("j"), F.lit(True).alias("right"))
    # products of two minor parts have negative numbers, so that they are none of a home part
    within = mixed.where("minor").select(*base, upto("q")).select("key", "id", "comp", (-1 - F.least("own", "o")).alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).alias("right"))
    blocks = home.unionByName(minor).unionByName(within).select(F.col("key").alias("k1"), F.col("i").alias("k2"), F.col("j").alias("k3"), "id", "right", "comp")
    second = cut(_compared(blocks, sets, percent), "links")
    comps = components(first.unionByName(second))

    named = same.join(comps, same["rep"] == comps["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = used.select("id", "digest", "n_shingles").join(named, "digest").select("id", "n_shingles", "component")
    rest = signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    return out.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group; columns as they come.

    Cases as in ``near_duplicates``; rows without id stay.
    """
    found = near_duplicates(docs, id_col, text_col, size, percent)
    gone = cut(found.where("id <> component").select(F.col("id").alias("near_id")).distinct(), "near")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"] == gone["near_id"], "left_anti")
