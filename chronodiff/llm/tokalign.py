"""Alignment of a text's tokens under two tokenizers, and of the two vocabularies over a corpus.

A task lays the tokens of many texts out in one frame a side, by byte position,
and pandas' ``merge_asof``, keyed by document, finds the covering token of the
other side for each token's start. Both directions together are all overlaps;
where the two starts are equal, a group begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.bpe import PATTERN, codec
from chronodiff.llm.tables import cut, small_batches
from chronodiff.llm.textnum import chunks

#: Bytes of text whose tokens are aligned at once; a longer text is alone.
PARTITION_BYTES = 2 << 20
#: Stretches of text whose tokens a task remembers, and their characters; beyond that it forgets all.
CACHED, CACHED_CHARS = 400_000, 32 << 20
#: Token pairs of a group that are written out one by one; in a larger group equal tokens are counted first.
GROUP_PAIRS = 64
#: Id pairs whose counts are sent to every task (some 17 bytes each); if there are more, the counts are joined.
BROADCAST_PAIRS = 4_000_000
#: Bits of the second id in a pair's key.
BITS = 24


class _Cache:
    """Ids by stretch of text: two ragged arrays that grow together."""

    def __init__(self):
        self.entry: dict[str, int] = {}
        self.chars = 0
        self.fine = np.zeros(0, bool)
        self.size = [np.zeros(0, np.int64)] * 2
        self.flat = [np.zeros(0, np.int32)] * 2

    def add(self, new: list[str], ids: list[tuple[np.ndarray, np.ndarray]], fine: np.ndarray) -> None:
        for s in new:
            self.entry[s] = len(self.entry)
        self.chars += sum(map(len, new))
        self.fine = np.concatenate([self.fine, fine])
        for side, (size, flat) in enumerate(ids):
            self.size[side] = np.concatenate([self.size[side], size])
            self.flat[side] = np.concatenate([self.flat[side], flat])

    def tokens(self, side: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these stretches one after the other, how many each has)."""
        size = self.size[side]
        n, start = size[entries], (np.cumsum(size) - size)[entries]
        at = np.cumsum(n) - n
        return self.flat[side][np.repeat(start - at, n) + np.arange(n.sum())], n


class Tokenizers:
    """A byte-level BPE file (side 0) and a sentencepiece model (side 1)."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        import tiktoken

        own = codec(byte_file)
        special = set(own.special.values())
        self.bytes_a = [own.token.get(i, b"") for i in range(max(own.token) + 1)]
        ranks = {t: i for i, t in own.token.items() if i not in special}
        merged = [c for _, _, c in own.rules]
        if merged != sorted(merged):
            raise ValueError(f"{byte_file}: ids do not follow the merges")
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << BITS:
            raise ValueError("too large a vocabulary")
        self.length = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        # no piece goes on over a space, and nothing is rewritten: then a text may be cut before a space
        probe = "a  \ufb01 e\u0301 \u2460"
        self.local = not any(re.search("[^▁]▁", p) for p in names) and self.bytes_of(self.pieces.encode(probe)) == (" " + probe).encode()
        self.cache = _Cache()

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_b.__getitem__, ids))

    def _encode(self, new: list[str]) -> None:
        """Remember the tokens of these stretches, each of which begins with a space."""
        raw = [s.encode() for s in new]
        usual = np.fromiter((len(s) > 1 and not s[1].isspace() and not s[-1].isspace() for s in new), bool, len(new))
        a: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        some = np.flatnonzero(usual).tolist()
        if some:  # these may follow each other in one text
            ids = np.array(self.plain.encode_ordinary("".join(new[k] for k in some)), np.int32)
            ends = np.cumsum(self.length[0][ids])
            at = np.searchsorted(ends, np.cumsum([len(raw[k]) for k in some])) + 1
            for k, part in zip(some, np.split(ids, at[:-1]), strict=True):
                a[k] = part
        for k in np.flatnonzero(~usual).tolist():
            a[k] = np.array(self.plain.encode_ordinary(new[k]), np.int32)
        b = self.pieces.encode([s[1:] for s in new], num_threads=1)
        fine = np.fromiter((self.bytes_of(ids) == r for ids, r in zip(b, raw, strict=True)), bool, len(new))
        count = lambda x: np.fromiter(map(len, x), np.int64, len(x))
        flat = [np.concatenate(a) if a else np.zeros(0, np.int32), np.fromiter((i for x in b for i in x), np.int32)]
        self.cache.add(new, [(count(a), flat[0]), (count(b), flat[1])], fine)

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry) of the stretches of all texts, row by row, and which rows have tokens.

        A stretch begins at a space that follows no space and precedes no white
        space: there both tokenizers begin a token, whatever stands before.
        """
        if len(self.cache.entry) > CACHED or self.cache.chars > CACHED_CHARS:
            self.cache = _Cache()
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        names, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        odd_word = np.fromiter((not s or s[0].isspace() for s in names), bool, len(names))
        odd = np.zeros(len(texts), bool)
        odd[row[odd_word[which]]] = True
        odd |= not self.local
        cutter = re.compile(r"(?<=[^ ])(?= \S)") if self.local else re.compile(r"(?!)")
        odd_rows = [(k, cutter.split(" " + texts[k].as_py())) for k in np.flatnonzero(odd).tolist() if texts[k].as_py()]
        known = self.cache.entry
        usual = ~odd[row]
        wanted = [" " + names[w] for w in np.unique(which[usual]).tolist()]
        new = list(dict.fromkeys(s for s in wanted if s not in known))
        seen = set(new)
        for _, parts in odd_rows:
            for s in parts:
                if s not in known and s not in seen:
                    seen.add(s)
                    new.append(s)
        if new:
            self._encode(new)
            known = self.cache.entry
        entry_of = np.full(len(names), -1, np.int64)
        entry_of[np.unique(which[usual])] = [known[s] for s in wanted]
        rows = [row[usual]] + [np.full(len(parts), k) for k, parts in odd_rows]
        entries = [entry_of[which[usual]]] + [np.array([known[s] for s in parts], np.int64) for _, parts in odd_rows]
        rows, entries = np.concatenate(rows), np.concatenate(entries)
        order = np.argsort(rows, kind="stable")
        rows, entries = rows[order], entries[order]
        fine = np.zeros(len(texts), bool)
        fine[rows] = True
        fine[rows[~self.cache.fine[entries]]] = False
        stay = fine[rows]
        return rows[stay], entries[stay], fine


@lru_cache(maxsize=2)
def tokenizers(byte_file: str, piece_file: str) -> Tokenizers:
    """One pair of tokenizers for each worker process."""
    return Tokenizers(byte_file, piece_file)


def _covers(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """For each token of ``left``, the token of ``right`` that covers its start, in the same document."""
    right = right.assign(index=np.arange(len(right)))
    return pd.merge_asof(left, right, on="start", by="doc", direction="backward")["index"].to_numpy(np.int64)


@lru_cache(maxsize=2)
def _digits(n: int) -> np.ndarray:
    """Each number below ``n`` in decimal, after a place for a separator; unused places are zero bytes."""
    width = len(str(n - 1))
    plain = np.frombuffer("".join(str(i).ljust(width, "\0") for i in range(n)).encode(), np.uint8).reshape(n, width)
    return np.concatenate([np.zeros((n, 1), np.uint8), plain], axis=1)


def _written(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray], n_docs: int, size: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of every document, one after the other, and where each ends."""
    numbers = _digits(size)
    n_groups = int(groups[0][-1]) + 1 if len(groups[0]) else 0
    per_a, per_b = (np.bincount(g, minlength=n_groups) for g in groups)
    place_a = np.arange(len(ids[0])) + (np.cumsum(per_b) - per_b)[groups[0]]
    place_b = np.arange(len(ids[1])) + np.cumsum(per_a)[groups[1]]
    total = len(ids[0]) + len(ids[1])
    all_ids, mark, doc = np.empty(total, np.int64), np.full(total, ord(","), np.uint8), np.empty(total, np.int64)
    all_ids[place_a], all_ids[place_b] = ids
    doc[place_a], doc[place_b] = docs
    first = lambda g: np.flatnonzero(np.diff(g, prepend=-1))
    mark[place_a[first(groups[0])]] = ord(";")
    mark[place_b[first(groups[1])]] = ord("|")
    mark[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
    text = numbers[all_ids]
    text[:, 0] = mark
    used = text != 0
    lengths = np.bincount(doc, weights=used.sum(axis=1), minlength=n_docs).astype(np.int64)
    return text[used].tobytes(), np.cumsum(lengths)


def _pairs(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], doc_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, times) of every id pair that a document links, and how often it does."""
    if not len(ids[0]):
        return (np.zeros(0, np.int64),) * 3
    n_a, n_b = np.bincount(groups[0]), np.bincount(groups[1])
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    small = (n_a * n_b <= GROUP_PAIRS)[groups[0]]
    a, g, d = ids[0][small].astype(np.int64), groups[0][small], doc_a[small]
    m = n_b[g]
    other = np.repeat(start_b[g] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    keys = [np.repeat(d << (2 * BITS) | a << BITS, m) | ids[1][other]]
    times = [np.ones(len(keys[0]), np.int64)]
    for k in np.flatnonzero(n_a * n_b > GROUP_PAIRS).tolist():
        one, c = np.unique(ids[0][start_a[k] : start_a[k] + n_a[k]].astype(np.int64), return_counts=True)
        two, e = np.unique(ids[1][start_b[k] : start_b[k] + n_b[k]].astype(np.int64), return_counts=True)
        keys.append(((doc_a[start_a[k]] << (2 * BITS)) | (one[:, None] << BITS) | two[None, :]).ravel())
        times.append((c[:, None] * e[None, :]).ravel())
    key, n = np.concatenate(keys), np.concatenate(times)
    if len(times) == 1:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    key, n = key[head], np.add.reduceat(n, head)
    return key >> (2 * BITS), key & ((1 << 2 * BITS) - 1), n


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _aligned(byte_file: str, piece_file: str, spans: bool):
    def one(own: Tokenizers, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        rows, entries, fine = own.split(texts)
        count = lambda x, **k: np.bincount(x, minlength=n, **k).astype(np.int64)
        tokens, doc, start, frames = [], [], [], []
        for side in (0, 1):
            t, per = own.cache.tokens(side, entries)
            size = own.length[side][t]
            tokens.append(t)
            doc.append(np.repeat(rows, per))
            start.append(np.cumsum(size) - size)  # documents lie one after the other, equally on both sides
            frames.append(pd.DataFrame({"start": start[side], "doc": doc[side]}))
        cover = [_covers(frames[0], frames[1]), _covers(frames[1], frames[0])]
        groups = tuple(np.cumsum(start[1 - s][cover[s]] == start[s]) - 1 for s in (0, 1))
        n_a, n_b = count(doc[0]), count(doc[1])
        per_a, per_b = (np.bincount(g) if len(g) else np.zeros(0, np.int64) for g in groups)
        group_doc = doc[0][np.flatnonzero(np.diff(groups[0], prepend=-1))] if len(doc[0]) else np.zeros(0, np.int64)
        text, ends = _written((tokens[0], tokens[1]), groups, (doc[0], doc[1]), n, max(len(own.bytes_a), len(own.bytes_b)))
        view, begins = memoryview(text), np.concatenate([[0], ends[:-1]])
        sha = [hashlib.sha256(view[a:b]).hexdigest() if ok else "" for a, b, ok in zip(begins.tolist(), ends.tolist(), fine.tolist(), strict=True)]
        pair_doc, key, times = _pairs((tokens[0], tokens[1]), groups, doc[0])
        per_doc = count(pair_doc)
        links = np.zeros(n, np.int64)
        np.add.at(links, group_doc, per_a * per_b)
        cols = {
            "id": ids, "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(count(group_doc)), "n_links": pa.array(links),
            "groups_sha256": pa.array(sha, pa.string()), "pairs": _lists(key, per_doc, pa.int64()), "times": _lists(times, per_doc, pa.int64()),
        }
        if spans:
            cols["groups"] = pa.array([text[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())
            both = np.concatenate([np.stack([np.arange(len(tokens[0])), cover[0]], 1), np.stack([cover[1], np.arange(len(tokens[1]))], 1)])
            both = np.unique(both, axis=0)  # the union of both directions
            at = doc[0][both[:, 0]]
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            cols["overlap_a"] = _lists(both[:, 0] - first_a[at], count(at), pa.int64())
            cols["overlap_b"] = _lists(both[:, 1] - first_b[at], count(at), pa.int64())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(byte_file, piece_file)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi, _, _ in chunks(texts, PARTITION_BYTES):
                yield one(own, batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo))

    return work


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """The alignment of every text's tokens under a byte-level BPE (a) and a sentencepiece model (b).

    A encodes space and text, B the text, to which it adds a space itself; no
    special tokens are made or read. Returns ``id_col``, ``n_a``, ``n_b``,
    ``n_groups`` (between byte offsets where a token of either side ends),
    ``n_links`` (pairs of tokens that share a group), ``groups_sha256`` (of
    ``a1,a2|b1;a3|b2,b3``), and ``pairs`` with ``times``: the id pairs linked,
    as ``a * 2 ** 24 + b``, and how often. With ``spans`` also ``groups`` as text, and
    ``overlap_a``, ``overlap_b``: indices of the tokens that overlap.

    Defined cases: a text that is null or empty, or that a side does not give
    back byte for byte, has no tokens, zeros and empty strings; a long run that
    is one group is counted by distinct ids, not pair by pair; rows that repeat
    are aligned each; a very long text is aligned alone, as a whole; an empty
    table stays empty; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    fields += ", groups string, overlap_a array<long>, overlap_b array<long>" * spans
    return rows.mapInArrow(_aligned(byte_file, piece_file, spans), fields).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``key``, ``docs`` (documents that link the pair) and ``best`` (whether no pair of its a has more)."""
    counts = aligned.select(F.explode("pairs").alias("key")).groupBy("key").agg(F.count("*").alias("docs"))
    counts = cut(counts.withColumn("a", F.shiftright("key", BITS)), "pairs")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))


def _scored(counts, known: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, best = counts.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = np.searchsorted(key, pairs.flatten().to_numpy())
            row, n = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy())), times.flatten().to_numpy()
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, n * best[at])
            np.add.at(sums[1], row, n * docs[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in known), *map(pa.array, sums)], [*known, "n_best", "count_sum"])

    return work


def align_corpus(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` without its pairs, and for each text how its links stand in the whole corpus.

    ``count_sum`` is the sum over links of how many documents link their id
    pair; ``n_best`` counts the links whose pair has the highest count of its
    a id, ties included. Counts of ``BROADCAST_PAIRS`` pairs or fewer go to every task;
    more are joined with the pairs, where a pair that most documents have is
    left to Spark's skew join. Cases as in ``align``.
    """
    spark = docs.sparkSession
    aligned = cut(align(docs, byte_file, piece_file, id_col, text_col).withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = cut(pair_counts(aligned), "counts")
    known = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() <= BROADCAST_PAIRS:
        got = counts.toArrow().sort_by("key")
        sent = spark.sparkContext.broadcast(tuple(got[c].to_numpy() for c in ("key", "docs", "best")))
        kind = aligned.schema["id"].dataType.simpleString()
        fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        out = aligned.select(*known, "pairs", "times").mapInArrow(_scored(sent, known), fields)
    else:
        links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("key"), F.col("p.times").alias("n"))
        best = F.when(F.col("best"), F.col("n")).otherwise(0)
        sums = links.join(counts, "key").groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = aligned.select("row", *known).join(sums, "row", "left").select(*known, zero("n_best"), zero("count_sum"))
    return out.withColumnRenamed("id", id_col)
