"""Whole-batch text work in numpy on Arrow's own buffers: words, hashes, segments.

Nothing here is per character or per word in Python: a batch of texts is one
byte array with document offsets, and words are pairs of positions in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 19

_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


_POWERS = _powers(1024)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern_bytes) -> np.ndarray:
    """A lookup table of 256 booleans, true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Everything but ASCII white space (space, tab to carriage return).
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Letters and digits of ASCII, and every byte of other characters.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; all bits of the result depend on all bits of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in the class, and runs before each text.

    A run never crosses from one text to the next.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_in = inside[buf]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    cuts = off[:-1][(off[:-1] < len(buf))]
    first[cuts] = is_in[cuts]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = is_in[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the bytes of each span; with ``lower``, A-Z count as a-z."""
    global _POWERS
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    size = ends - starts
    if (longest := int(size.max())) > len(_POWERS):
        _POWERS = _powers(2 * longest)
    heads = np.cumsum(size) - size
    rel = np.arange(int(size.sum()), dtype=np.int64)
    at = rel + np.repeat(starts - heads, size)
    rel -= np.repeat(heads, size)
    got = buf[at]
    values = (LOWER[got] if lower else got).astype(np.uint64) + np.uint64(1)
    values *= _POWERS[rel]
    return mix(np.add.reduceat(values, heads) + size.astype(np.uint64) * np.uint64(_ODD))


def hash_word(word: str) -> int:
    """The hash that ``hash_spans`` gives a word (lower-cased in A-Z)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])


def ngrams(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside each text, and n-grams before each text."""
    if n == 1:
        return h, before
    count = np.diff(before)
    kept = np.maximum(count - n + 1, 0)
    total = np.concatenate([[0], np.cumsum(kept)])
    if not total[-1]:
        return np.zeros(0, np.uint64), total
    at = np.arange(int(total[-1])) + np.repeat(before[:-1] - total[:-1], kept)
    out = h[at] * np.uint64(0xA24BAED4963EE407)
    for k in range(1, n):
        out = mix(out + h[at + k] * np.uint64((0x9FB21C651E98DF25 * (2 * k + 1)) & (2**64 - 1)))
    return out, total


def segment_sum(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of values[before[i]:before[i + 1]]; empty segments give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[before[1:]] - total[before[:-1]]
