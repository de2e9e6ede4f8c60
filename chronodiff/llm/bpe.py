"""Byte-pair encoding and decoding with a given vocabulary file, by an index of pair positions.

The words of many texts are laid out as one row of symbols. An index maps each
adjacent pair that has a rank to all its positions; the active ranks are taken
in ascending order, every listed position that still holds the pair is merged,
and the lists of the pairs left and right of it are updated. So each merge rule
is looked at once for all the words, not once for every word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.ftrl import give_back
from chronodiff.llm.tables import small_batches
from chronodiff.llm.textnum import chunks

#: Bytes of text that share one index of pair positions.
PARTITION_BYTES = 2 << 20
#: Words whose ids a task remembers at most; beyond that it forgets all of them.
CACHED_WORDS = 100_000

#: The split pattern of byte-level pre-tokenisation (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not plain or not level or odd or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = model["vocab"]
        self.byte_ids = np.array([vocab[letters[b]] for b in range(255)] + [-1], np.int32)
        self.token: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        if max(vocab.values()) >= 65535:
            raise ValueError(f"{path}: ids of 65,535 or more")
        self.rules: list[tuple[int, int, int]] = []
        self.rule: dict[int, int] = {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rule.setdefault(vocab[left] * 65536 + vocab[right], len(self.rules))
            self.rules.append((vocab[left], vocab[right], vocab[left + right]))
        by_key = sorted(self.rule.items())
        self.rule_key = np.array([k for k, _ in by_key] + [2**62])
        self.rule_rank = np.array([r for _, r in by_key] + [len(by_key)], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order."""
        if self.at_special is None or not self.at_special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words(text[at:])

    def _ranks(self, sym: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each position; one past the last where it has none."""
        key = sym[at].astype(np.int64) * 65536 + sym[after[at]]
        found = np.searchsorted(self.rule_key, key)
        return np.where(self.rule_key[found] == key, self.rule_rank[found], len(self.rules))

    def learn(self, words: list[str]) -> None:
        """Put the ids of these distinct words into ``known``."""
        raw = np.frombuffer(b"\xff".join(w.encode() for w in words) + b"\xff\xff", np.uint8)
        sym = self.byte_ids[raw]  # byte 255 is in no UTF-8 text: it ends a word
        n, none = len(sym), len(self.rules)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[-1] = n - 1
        one_sym, one_after, one_before = memoryview(sym), memoryview(after), memoryview(before)
        merged = np.zeros(n, bool)
        many: dict[int, list[np.ndarray]] = {}
        few: dict[int, list[int]] = {}  # positions that come one by one or by threes; an array of one takes five times the memory
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = self._ranks(sym, at, after)
            at, ranks = at[ranks < none], ranks[ranks < none]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1, [len(at)]]).tolist()
            listed = at.tolist()
            for rank, head, end in zip(ranks[heads[:-1]].tolist(), heads, heads[1:], strict=False):
                if rank not in few and rank not in many:
                    heappush(active, rank)
                if end - head > 4:
                    many.setdefault(rank, []).append(at[head:end])
                elif rank in few:
                    few[rank] += listed[head:end]
                else:
                    few[rank] = listed[head:end]

        def add_one(at: int) -> None:
            rule = self.rule.get(one_sym[at] * 65536 + one_sym[one_after[at]])
            if rule is not None:
                if rule in few:
                    few[rule].append(at)
                    return
                few[rule] = [at]
                if rule not in many:
                    heappush(active, rule)

        add(np.arange(n, dtype=np.int32))
        while active:
            rank = heappop(active)
            spots, arrays = few.pop(rank, []), many.pop(rank, [])
            a, b, new = self.rules[rank]
            if not arrays and len(spots) <= 4:
                if a == b:  # only such pairs overlap, and then the left one is merged
                    spots.sort()
                for p in spots:
                    q = one_after[p]
                    if one_sym[p] != a or one_sym[q] != b or p == q:
                        continue
                    one_sym[p], one_sym[q] = new, -2
                    r = one_after[p] = one_after[q]
                    one_before[r] = p
                    if (left := one_before[p]) >= 0:
                        add_one(left)
                    add_one(p)
                continue
            spots = np.concatenate([*arrays, np.array(spots, np.int32)])
            if a == b:
                spots.sort()
            q = after[spots]
            held = (sym[spots] == a) & (sym[q] == b)
            spots, q = spots[held], q[held]
            if a == b and len(spots):  # in a run of equal symbols every second pair is merged
                runs = np.flatnonzero(np.concatenate([[True], spots[1:] != q[:-1]]))
                nth = np.arange(len(spots)) - np.repeat(runs, np.diff(np.append(runs, len(spots))))
                spots, q = spots[nth % 2 == 0], q[nth % 2 == 0]
            sym[spots], sym[q] = new, -2
            r = after[q]
            after[spots], before[r] = r, spots
            left = before[spots]
            merged[spots] = True
            left = left[(left >= 0) & ~merged[left]]
            merged[spots] = False
            add(np.concatenate([left, spots]))
        stay = sym != -2
        ids = sym[stay]
        ends = np.flatnonzero(ids == -1)[:-1].tolist()
        flat = ids.astype("<u4").tobytes()
        start = 0
        for w, end in zip(words, ends, strict=True):
            self.known[w] = flat[4 * start : 4 * end]
            start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        same: dict[str, str] = {}  # equal words are one string, so that a text's list is 8 bytes a word
        split = [list(map(same.setdefault, words, words)) for words in map(self.pieces, texts)]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        for t, i in self.special.items():
            self.known[t] = i.to_bytes(4, "little")
        fresh = same.keys() - self.known.keys()
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids; bytes that are not UTF-8 become the replacement character."""
        get = self.token.__getitem__
        return [b"".join(map(get, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def _round_trip(vocab_file: str, decode: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab_file)
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1), PARTITION_BYTES):
                raw, ends = data.tobytes(), off.tolist()
                texts = [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]
                ids = own.encode(texts)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array(own.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", "decoded"][: len(cols)])
        give_back()  # the worker stays, beside the JVM's later work

    return work


def encode(docs: DataFrame, vocab_file: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every text.

    With ``decode``, also ``decoded``: the text that the ids give back. Added
    tokens written in a text get their own ids, as the tokenizers library does.
    No shuffle; a task holds the words of ``PARTITION_BYTES`` of text, or of
    one longer text. Defined cases: null counts as the empty text, which has no
    ids; rows that repeat are encoded each, equal texts alike; of pairs of equal
    rank the left one is merged first; an empty table stays empty; other
    columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_round_trip(vocab_file, decode), f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of ids as ``encode`` gives them; null ids give the empty text."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocab_file)
        for batch in batches:
            texts = own.decode([x or b"" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, text string").withColumnRenamed("id", id_col)
