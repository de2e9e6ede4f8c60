"""Passages of 50 bytes or more that an earlier document has: anchors, a run-length index, spans to remove.

Every 50-byte window of a text has one anchor: the 20 bytes of it with the
smallest hash, the first of them on a tie. Equal windows have equal anchors, so
only windows around anchors that several documents share can repeat. The bytes
around those anchors are gathered by anchor. Surroundings of the first documents
go into a run-compressed Burrows-Wheeler index with samples at run ends; the
others are streamed through it, and matching statistics of 50 or more tell which
windows an earlier document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut, small_batches
from chronodiff.llm.textnum import chunks, mix

#: Bytes of a match, and of an anchor in it.
MATCH, ANCHOR = 50, 20
#: Bytes of text worked on at once; a longer text is worked on alone.
PART = 1 << 20
#: Anchors that a task holds before it hands them on (a tenth of it with their text), and that a group of anchor hashes holds on average.
HELD, GROUP = 2_000_000, 4_000_000
#: Bytes of the longest surrounding: all windows of one anchor.
WIDEST = 2 * MATCH - ANCHOR
#: Bytes of text for each group of anchors; what is shared of them goes into it.
GROUP_BYTES = 4 << 20
#: Bytes that an index holds at most, and texts streamed through it at once.
MAX_INDEX, STREAMED = 1 << 20, 1 << 14
#: A group of more bytes is looked through for anchors of more surroundings than ``HOT`` (counted by parts), which are
#: settled by an aggregation over their windows, not in one task.
LARGE, HOT = 64 << 20, 50_000
#: Up to so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The filter of shared anchors has 2 ** bits bits: this many at most (32 MB).
MAX_FILTER_BITS = 28

_BASE = 0xD6E8FEB86659FD93


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) & (2**64 - 1)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Hasher:
    """Hashes of byte ranges of one part of text, from prefix sums of a polynomial."""

    up, down = _powers(1024, _BASE), _powers(1024, _inverse(_BASE))

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if n > len(Hasher.up):
            size = max(n, PART + 1024)
            Hasher.up, Hasher.down = _powers(size, _BASE), _powers(size, _inverse(_BASE))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """The hash of each run of ``size`` bytes, by its first byte."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def anchors(buf: np.ndarray, off: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor; windows are named by their first byte.

    A window lies inside one text. Runs of windows with the same anchor are one row.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < MATCH:
        return none.astype(np.uint64), none, none
    h = hasher.every(ANCHOR)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, n = MATCH - ANCHOR + 1, len(buf) - MATCH + 1
    have = 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    m = np.minimum(m[:n], m[width - have : width - have + n])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + MATCH + 1, np.int32)
    ends = off[1:-1]
    np.add.at(inside, np.clip(ends - MATCH + 1, 0, n), 1)
    np.add.at(inside, np.clip(ends, 0, n), -1)
    window = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    if not len(window):
        return none.astype(np.uint64), none, none
    at = at[window]
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = window[np.append(head[1:], len(window)) - 1]
    return h[at[head]], window[head], last


def _shared(bits: int):
    """Anchor hashes of a task's texts, by their top ``bits``: those of one text, those of several."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, text = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, text = h[order], text[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(text, head) != np.maximum.reduceat(text, head)
        h = h[head]
        group = (h >> np.uint64(64 - bits)).astype(np.int64)
        low = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cuts = np.searchsorted(group, np.arange((1 << bits) + 1))
        rows = [(g, low[a:b][~several[a:b]].tobytes(), low[a:b][several[a:b]].tobytes()) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["part", "one", "several"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(1), PART):
                h, first, _ = anchors(buf, off, Hasher(buf))
                if len(h):
                    held.append((h, np.searchsorted(off, first, "right") + texts))
                size, texts = size + len(h), texts + len(off)
                if size > HELD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return work


def _filter_slice(bits: int, filter_bits: int):
    """The part of the filter that belongs to one group of hashes: a bit for each that several texts have."""

    def work(table: pa.Table) -> pa.Table:
        one = np.sort(np.frombuffer(b"".join(table["one"].to_pylist()), "<u4"))
        twice = one[1:][one[1:] == one[:-1]]
        several = np.frombuffer(b"".join(table["several"].to_pylist()), "<u4")
        spot = np.concatenate([twice, several]) >> np.uint32(32 + bits - filter_bits)
        flags = np.zeros(1 << (filter_bits - bits), np.uint8)
        flags[spot] = 1
        return pa.table({"part": table["part"].slice(0, 1).cast(pa.int64()), "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return work


PACKED = "g long, place long, n_bytes long, texts binary, docs binary"


def _group(h: np.ndarray, n_groups: int) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)


def _check(h: np.ndarray) -> np.ndarray:
    return h.astype(np.int32)


def _shared_anchors(batches: Iterator[pa.RecordBatch], flags: np.ndarray, filter_bits: int) -> Iterator[tuple]:
    """(anchor, surrounding, document, place in it, first and last window, bytes) of the anchors in the filter, part by part."""
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64)
        for lo, _, buf, off in chunks(batch.column(1), PART):
            hasher = Hasher(buf)
            h, first, last = anchors(buf, off, hasher)
            spot = h >> np.uint64(64 - filter_bits)
            on = (flags[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 > 0
            h, first, last = h[on].view(np.int64), first[on], last[on]
            if len(h):
                row = np.searchsorted(off, first, "right") - 1
                yield h, _name(hasher, first, last), ids[lo + row], first - off[row], first, last, buf


def _places(shared, filter_bits: int):
    """A row for each place of a shared anchor: its surrounding's hash (``s``), 32 bits of the anchor's (``c``), document, place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, s, doc, place, *_ in _shared_anchors(batches, shared.value, filter_bits):
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(_check(h)), pa.array(doc), pa.array(place)], ["s", "c", "doc", "place"])

    return work


def _texts(shared, filter_bits: int, n_groups: int):
    """The different surroundings of shared anchors: packed rows, one for each group of anchors (``g``) of a part.

    A surrounding is all bytes of the windows of one anchor. A row holds
    compressed bytes, and compressed lengths, first and last documents.
    """

    def packed(held: list[tuple]) -> pa.RecordBatch:
        s, h, doc, part, first, last = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
        raws = [x[6] for x in held]
        order = np.lexsort((doc, h, s))
        s, h, doc = s[order], h[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        tail = np.append(head[1:], len(s)) - 1
        group = _group(h[head], n_groups)
        by = np.argsort(group, kind="stable")
        head, tail, group = head[by], tail[by], group[by]
        at = order[head]
        seg = [raws[p][a : b + MATCH] for p, a, b in zip(part[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True)]
        size = (last[at] - first[at] + MATCH).astype(np.uint8)
        low, high = doc[head], doc[tail]
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            text = b"".join(seg[a:b])
            rows.append((int(group[a]), len(text), pa.compress(text, "zstd", asbytes=True), pa.compress(size[a:b].tobytes() + low[a:b].tobytes() + high[a:b].tobytes(), "zstd", asbytes=True), b - a))
        g, n, texts, docs, count = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(texts, pa.binary()), pa.array(docs, pa.binary())], ["g", "place", "n_bytes", "texts", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for h, s, doc, _, first, last, buf in _shared_anchors(batches, shared.value, filter_bits):
            held.append((s, h, doc, np.full(len(h), len(held)), first, last, buf.tobytes()))
            size += len(h)
            if size > HELD // 10:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return work


#: No document has this window.
NOBODY = np.iinfo(np.int64).max


def suffix_order(sym: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each up to the end of its text; equal ones by position.

    Ranks of 5 bytes, then of 10, 20, 40 and 80: rank, rank of what follows and
    position are one number, so every round is a plain sort.
    """
    n, bits = len(sym), np.uint64(21)
    place, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << 21) - 1)
    padded = np.concatenate([sym, np.zeros(4, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + n], np.uint64(0))
    depth = 5
    while True:
        key = np.sort((key << bits) | place)
        order = (key & mask).astype(np.int64)
        key >>= bits
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if depth >= WIDEST or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        more = np.zeros(n, np.uint64)
        some = np.flatnonzero(left > depth)
        more[some] = rank[some + depth]
        key = (rank << bits) | more
        depth *= 2


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of many short texts, sampled at the ends of its runs.

    Kept are the runs (first row, symbol, row to which the first row steps
    back) and the positions of their first and last rows. ``above`` follows
    from these samples alone: the suffix one row up. Where the rows of p + 1
    and of the suffix above it carry the same symbol, the suffix above p is one
    byte before that; else p + 1 begins a run, and the suffix above p is one
    byte before the last row of the run before, in the order of symbols.
    """

    def __init__(self, sym: np.ndarray, size: np.ndarray, docs: np.ndarray):
        """``sym``: bytes of the texts plus 1, a 0 behind each; ``docs``: the document of each text."""
        n = len(sym)
        if n > MAX_INDEX:
            raise ValueError(f"{n} bytes are too many for an index")
        ends = np.cumsum(size + 1)
        left = np.repeat(ends, size + 1) - np.arange(n)
        order = suffix_order(sym, left)
        begins = np.zeros(n, bool)
        begins[ends - size - 1] = True
        symbol = np.where(begins[order], 0, sym[order - 1])
        self.run = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0)]))
        self.symbol = symbol[self.run]
        last = np.append(self.run[1:], n) - 1
        self.length = last - self.run + 1
        self.head, self.tail = order[self.run], order[last]
        self.by = np.argsort(self.symbol, kind="stable")
        self.key = self.symbol[self.by].astype(np.int64) * len(self.run) + self.by
        self.target = np.empty(len(self.run), np.int64)
        self.target[self.by] = np.cumsum(self.length[self.by]) - self.length[self.by]
        self.text = np.concatenate([sym, np.zeros(WIDEST, np.uint8)])
        self._sample(ends)
        self.first = self._first_documents(np.flatnonzero(left > MATCH), np.repeat(docs, size + 1))

    def _sample(self, ends: np.ndarray) -> None:
        before = np.empty(len(self.run), np.int64)
        before[self.by[1:]] = self.tail[self.by[:-1]]
        inner = self.symbol > 0
        if inner.any():  # above the first symbol's rows are those of the ends
            before[self.by[int((~inner).sum())]] = ends[-1]
        at = np.concatenate([self.head[inner] - 1, ends - 1])
        above = np.concatenate([before[inner] - 1, [-2 * len(self.text)], ends[:-1] - 1])
        by = np.argsort(at)
        self.sample_at, self.sample = at[by], above[by]

    def above(self, at: np.ndarray) -> np.ndarray:
        """The position whose suffix is one row up; negative for the first row."""
        k = np.searchsorted(self.sample_at, at)
        return self.sample[k] - (self.sample_at[k] - at)

    def _first_documents(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each position with a window: the smallest document among the equal windows in the rows around it."""
        out = np.full(len(self.text), NOBODY)
        if not len(at):
            return out
        name = Hasher(self.text).every(MATCH)
        number = np.full(len(self.text), -1)
        number[at] = np.arange(len(at))
        up = self.above(at)
        up[up < 0] = len(self.text) - 1
        equal = (number[up] >= 0) & (name[at] == name[np.minimum(up, len(name) - 1)])
        top = np.where(equal, number[up], np.arange(len(at)))
        while not np.array_equal(higher := top[top], top):
            top = higher
        least = np.full(len(at), NOBODY)
        np.minimum.at(least, top, doc[at])
        out[at] = least[top]
        return out

    def _common(self, own: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many bytes of ``own`` (rows of as many columns as the longest length) the text at ``at`` shares, ``length`` at most."""
        differs = self.text[at[:, None] + np.arange(own.shape[1])] != own
        return np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), own.shape[1]) if own.shape[1] else 0, length)

    def stream(self, texts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The smallest indexed document that has each window of other texts, by matching statistics.

        ``texts`` are rows of ``WIDEST`` symbols, flush right, longest first.
        All are read from their ends at once. A text's state is a row, that
        row's position, and how many bytes match from there. Where the row's
        run has the text's byte, one step back makes the match longer; else
        the state moves to the nearest runs of that byte, above or below, whose
        sampled ends tell which of both keeps more of the match.
        """
        k = len(size)
        row, at, length = np.zeros(k, np.int64), np.full(k, self.head[0]), np.zeros(k, np.int64)
        out = np.full((k, WIDEST - MATCH + 1), NOBODY)
        runs = len(self.run)
        for step in range(1, int(size[0]) + 1 if k else 1):
            m = int(np.searchsorted(-size, -step, "right"))
            c = texts[:m, WIDEST - step].astype(np.int64)
            run = np.searchsorted(self.run, row[:m], "right") - 1
            lost = np.flatnonzero(self.symbol[run] != c)
            stay = lost[:0]
            if len(lost):
                spot = np.searchsorted(self.key, c[lost] * runs + run[lost])
                near = [np.maximum(spot - 1, 0), np.minimum(spot, runs - 1)]
                there = [(self.key[x] // runs == c[lost]) & ok for x, ok in zip(near, (spot > 0, spot < runs), strict=True)]
                near = [self.by[x] for x in near]
                begin = WIDEST - step + 1
                own = texts[lost, begin : begin + int(length[lost].max())]
                kept = [np.where(ok, self._common(own, end[x], length[lost]), -1) for x, ok, end in zip(near, there, (self.tail, self.head), strict=True)]
                up = kept[0] >= kept[1]
                run[lost] = np.where(up, near[0], near[1])
                row[lost] = self.run[run[lost]] + np.where(up, self.length[run[lost]] - 1, 0)
                at[lost] = np.where(up, self.tail[run[lost]], self.head[run[lost]])
                length[lost] = np.maximum(kept[0], kept[1])
                stay = lost[length[lost] < 0]  # the byte is in no indexed text
            held = row[stay], at[stay]
            row[:m] = self.target[run] + row[:m] - self.run[run]
            at[:m] -= 1
            length[:m] += 1
            row[stay], at[stay] = held
            if step >= MATCH:
                long = np.flatnonzero(length[:m] >= MATCH)
                out[long, size[long] - step] = self.first[at[long]]
        return out


def _taken(buf: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those texts as symbols with a 0 behind each, and their sizes."""
    size = off[rows + 1] - off[rows]
    begin = np.cumsum(size + 1) - (size + 1)
    sym = np.zeros(int((size + 1).sum()), np.uint8)
    rel = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    sym[rel + np.repeat(begin, size)] = buf[rel + np.repeat(off[rows], size)] + np.uint8(1)  # UTF-8 has no byte 255
    return sym, size


def first_documents(buf: np.ndarray, off: np.ndarray, docs: np.ndarray, start: int | None = None) -> np.ndarray:
    """For every window of the texts, text by text: the smallest document that has it.

    In rounds: the texts of the smallest documents are indexed, the others are
    streamed through the index. A window found there is settled, as no text
    outside the index has a smaller document; texts all of whose windows are
    settled are never indexed. So of texts that repeat little is indexed. The
    first round takes a quarter of the bytes, each other twice as many as the
    one before, ``MAX_INDEX`` at most.
    """
    start = min(MAX_INDEX, start or max(1 << 15, len(buf) // 4))
    windows = np.diff(off) - MATCH + 1
    begin = np.cumsum(windows) - windows
    out = np.full(int(windows.sum()), NOBODY)
    todo = np.argsort(docs, kind="stable")
    while len(todo):
        held = max(1, int(np.searchsorted(np.cumsum(off[todo + 1] - off[todo] + 1), start, "right")))
        own, todo = todo[:held], todo[held:]
        sym, size = _taken(buf, off, own)
        index = RunIndex(sym, size, docs[own])
        rel = np.arange(int(windows[own].sum())) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
        at = rel + np.repeat(np.cumsum(size + 1) - (size + 1), windows[own])
        spot = rel + np.repeat(begin[own], windows[own])
        out[spot] = np.minimum(out[spot], index.first[at])
        open_ = []
        for lo in range(0, len(todo), STREAMED):
            rows = todo[lo : lo + STREAMED]
            rows = rows[np.argsort(-windows[rows], kind="stable")]
            sym, size = _taken(buf, off, rows)
            texts = np.zeros((len(rows), WIDEST), np.uint8)
            rel = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            texts[np.repeat(np.arange(len(rows)), size), rel + np.repeat(WIDEST - size, size)] = sym[sym > 0]
            found = index.stream(texts, size)
            column = np.arange(found.shape[1])
            there = column[None, :] < windows[rows][:, None]
            spot = (begin[rows][:, None] + column)[there]
            out[spot] = np.minimum(out[spot], found[there])
            unsettled = np.zeros(len(rows), bool)
            unsettled[np.repeat(np.arange(len(rows)), windows[rows])[out[spot] == NOBODY]] = True
            open_.append(rows[unsettled])
        todo = np.concatenate([todo[:0], *open_])
        todo = todo[np.argsort(docs[todo], kind="stable")]
        start = min(2 * start, MAX_INDEX)
    return out


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, surrounding, first document, last document) of the different texts of packed rows, in order of the anchors; bytes, offsets."""
    parts, raws = [], []
    for n, count, texts, docs in zip(*(table[c].to_pylist() for c in ("n_bytes", "place", "texts", "docs")), strict=True):
        raw = np.frombuffer(pa.decompress(texts, n, "zstd", asbytes=True), np.uint8)
        meta = pa.decompress(docs, 17 * count, "zstd", asbytes=True)
        off = np.concatenate([[0], np.cumsum(np.frombuffer(meta, np.uint8, count), dtype=np.int64)])
        hasher = Hasher(raw)
        h, first, last = anchors(raw, off, hasher)
        parts.append((h.view(np.int64), _name(hasher, first, last), np.frombuffer(meta, np.int64, count, count), np.frombuffer(meta, np.int64, count, 9 * count), np.diff(off)))
        raws.append(raw)
    h, s, doc, last, size = (np.concatenate([p[k] for p in parts]) for k in range(5))
    buf = np.concatenate(raws)
    order = np.lexsort((s, h))
    h, s = h[order], s[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
    doc, last = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(last[order], head)
    at = order[head]
    off = np.concatenate([[0], np.cumsum(size)])
    own = size[at]
    new = np.concatenate([[0], np.cumsum(own)])
    buf = buf[np.arange(int(new[-1])) + np.repeat(off[at] - new[:-1], own)]
    return h[head], s[head], doc, last, buf, new


def _answers(table: pa.Table) -> pa.Table:
    """(s, c, lo, hi, first): windows lo to hi of that surrounding have ``first`` as their smallest document.

    Anchors are settled in batches, as different ones share no window.
    """
    h, s, doc, last, buf, off = _unpacked(table)
    anchor = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    ends = np.append(anchor[1:], len(h))
    latest = np.maximum.reduceat(last, anchor)
    wide = np.minimum.reduceat(doc, anchor) != latest
    out, batch, held = [], [], 0
    for a, b, some, late in zip(anchor.tolist(), ends.tolist(), wide.tolist(), latest.tolist(), strict=True):
        if some:
            batch.append((a, b, late))
            held += int(off[b] - off[a])
        if held >= MAX_INDEX or (batch and b == len(h)):
            out.append(_settled(h, s, doc, buf, off, batch))
            batch, held = [], 0
    if batch:
        out.append(_settled(h, s, doc, buf, off, batch))
    cols = [np.concatenate([np.zeros(0, np.int64), *[x[k] for x in out]]) for k in range(5)]
    return pa.table({"s": cols[0], "c": _check(cols[1]), "lo": cols[2], "hi": cols[3], "first": cols[4]})


def _settled(h: np.ndarray, s: np.ndarray, doc: np.ndarray, buf: np.ndarray, off: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    rows = np.concatenate([np.arange(a, b) for a, b, _ in batch])
    late = np.repeat([x for _, _, x in batch], [b - a for a, b, _ in batch])
    size = off[rows + 1] - off[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    own = buf[np.arange(int(new[-1])) + np.repeat(off[rows] - new[:-1], size)]
    first = first_documents(own, new, doc[rows])
    n = size - MATCH + 1
    windows = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] != first[:-1])]))
    tail = np.append(head[1:], len(first)) - 1
    head, tail = (x[first[head] < late[text[head]]] for x in (head, tail))
    text, first = text[head], first[head]
    return s[rows][text], h[rows][text], head - windows[text], tail - windows[text], first


def _name(hasher: Hasher, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(hasher.ranges(first, last + MATCH) + (last - first).astype(np.uint64)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of each anchor in packed rows."""
    for batch in batches:
        for k in range(len(batch)):
            h, n = np.unique(_unpacked(pa.Table.from_batches([batch.slice(k, 1)]))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _without(hot: np.ndarray):
    """Packed rows without the surroundings of those anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                h, _, doc, last, buf, off = _unpacked(row)
                stay = np.flatnonzero(~np.isin(h, hot))
                if not len(stay):
                    continue
                size = off[stay + 1] - off[stay]
                text = b"".join(buf[off[r] : off[r + 1]].tobytes() for r in stay.tolist())
                docs = size.astype(np.uint8).tobytes() + doc[stay].tobytes() + last[stay].tobytes()
                cols = [row["g"].combine_chunks(), pa.array([len(stay)], pa.int64()), pa.array([len(text)], pa.int64()), *[pa.array([pa.compress(x, "zstd", asbytes=True)], pa.binary()) for x in (text, docs)]]
                yield pa.RecordBatch.from_arrays(cols, ["g", "place", "n_bytes", "texts", "docs"])

    return work


def _windows_of(hot: np.ndarray):
    """A row for each window of the surroundings of those anchors: its 128-bit name and its first and last document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                h, s, doc, last, buf, off = _unpacked(pa.Table.from_batches([batch.slice(k, 1)]))
                own = np.flatnonzero(np.isin(h, hot))
                if not len(own):
                    continue
                hasher, half = Hasher(buf), MATCH // 2
                n = off[own + 1] - off[own] - MATCH + 1
                row = np.repeat(own, n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = off[row] + place
                w1 = hasher.every(MATCH)[at]
                w2 = mix(hasher.ranges(at, at + half) * np.uint64(3) + hasher.ranges(at + half, at + MATCH))
                cols = [s[row], _check(h[row]), place, w1.view(np.int64), w2.view(np.int64), doc[row], last[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["s", "c", "place", "w1", "w2", "doc", "last"])

    return work


def _hot_answers(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Answers for anchors whose surroundings are too many for one task: an aggregation over their windows."""
    windows = cut(texts.mapInArrow(_windows_of(hot), "s long, c int, place long, w1 long, w2 long, doc long, last long"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("last").alias("late")).where("first < late").drop("late")
    return windows.join(first, ["w1", "w2"]).select("s", "c", F.col("place").alias("lo"), F.col("place").alias("hi"), "first").distinct()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, starts, ends) with overlapping and touching spans made one."""
    for batch in batches:
        out = []
        for starts, ends in zip(batch.column(1), batch.column(2), strict=True):
            a, b = starts.values.to_numpy(), ends.values.to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            out.append((a[head], b[np.append(head[1:], len(a)) - 1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], pa.list_(pa.int64())) for k in (0, 1)]], ["id", "starts", "ends"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, whole, starts, ends) to what goes and a digest of what stays."""
    for batch in batches:
        whole, lists = batch.column(2).to_pylist(), [batch.column(k).to_pylist() for k in (3, 4)]
        for lo, hi, buf, off in chunks(batch.column(1), PART):
            out = []
            for k in range(lo, hi):
                own = buf[off[k - lo] : off[k - lo + 1]]
                depth = np.zeros(len(own) + 1, np.int64)
                if whole[k] and len(own) >= MATCH:
                    depth[0], depth[-1] = 1, -1
                elif lists[0][k]:
                    np.add.at(depth, lists[0][k], 1)
                    np.add.at(depth, lists[1][k], -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), spans, kept))
            n, removed, spans, kept = zip(*out, strict=True)
            cols = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (bytes) of every row.

    A byte goes if a 50-byte string over it also starts in a document with a
    smaller (integer) id; overlaps count, and strings are judged on the input.

    1. Rows with a text that a smaller id has whole lose all of it (50 bytes or
       more) and add nothing for others.
    2. Anchor hashes that several texts have are found group by group of
       hashes; a bit filter of at most 2 ** MAX_FILTER_BITS bits carries them to
       the tasks. What it lets through too much is only more work.
    3. The different surroundings of an anchor go to the indexes of its group,
       each once for a task. The answers are joined with the places of shared
       anchors, in a join that Spark may split.
    4. An anchor of very many different surroundings would make a group without
       bound. Its windows are rows instead, aggregated with map-side combining.
       There are at most surroundings / ``HOT`` such anchors.

    Defined cases: null is the empty text; texts of fewer than 50 bytes stay;
    rows without id stay whole and count as no document; rows that share an id
    are one document and do not repeat each other; of equal documents the
    smallest id keeps its bytes; a very long text is windowed whole, in the task
    that has its row; an empty table stays empty; other columns, whatever their
    names, are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    keys = cut(rows.where("id is not null").select("id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(3), "text").alias("b")).where(F.col("n") >= MATCH), "texts")
    first = keys.groupBy("n", "a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    whole = cut(keys.join(first, ["n", "a", "b"]).where("id <> first").select("id", "a", "b"), "copies")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = whole.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    copy_key = [F.col("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(3), "text").alias("b")]
    marked = rows.select("id", "text", *copy_key[1:]).join(
        (F.broadcast if few else lambda x: x)(whole.distinct().withColumn("whole", F.lit(True))), ["id", "a", "b"], "left"
    ).drop("a", "b")
    source = marked.where("id is not null and whole is null").where(F.octet_length("text") >= MATCH).select("id", "text")

    guess = max(total // 12, 1)
    bits = min(20, max(4, int(np.ceil(np.log2(guess / GROUP + 1)))))
    filter_bits = min(MAX_FILTER_BITS, max(bits + 6, int(np.ceil(np.log2(guess * 2)))))
    groups = source.mapInArrow(_shared(bits), "part long, one binary, several binary")
    parts = groups.groupBy("part").applyInArrow(_filter_slice(bits, filter_bits), "part long, flags binary")
    flags = np.zeros(1 << (filter_bits - 3), np.uint8)
    step = 1 << (filter_bits - bits - 3)
    for r in parts.toLocalIterator():
        flags[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["flags"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(flags)

    n_groups = int(total // GROUP_BYTES) + 1
    texts = cut(source.mapInArrow(_texts(shared, filter_bits, n_groups), PACKED), "surroundings")
    places = source.mapInArrow(_places(shared, filter_bits), "s long, c int, doc long, place long")
    shape = "s long, c int, lo long, hi long, first long"
    answers = texts.groupBy("g").applyInArrow(_answers, shape)
    large = cut(texts.groupBy("g").agg(F.sum("n_bytes").alias("n")).where(F.col("n") > LARGE).select("g"), "large")
    if n_large := large.count():
        keys = F.broadcast(large) if n_large <= BROADCAST_IDS else large
        their = cut(texts.join(keys, "g"), "large")
        hot = their.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
        hot = hot.select("h").toArrow()["h"].to_numpy()
        rest = texts.join(keys, "g", "left_anti").unionByName(their.mapInArrow(_without(hot), PACKED))
        answers = rest.groupBy("g").applyInArrow(_answers, shape).unionByName(_hot_answers(their, hot))
    hits = places.join(answers, ["s", "c"]).where("first < doc")
    spans = hits.groupBy("doc").agg(F.collect_list(F.col("place") + F.col("lo")).alias("starts"), F.collect_list(F.col("place") + F.col("hi") + MATCH).alias("ends"))
    spans = cut(spans.mapInArrow(_merge, f"id {kind}, starts array<long>, ends array<long>"), "spans")
    small = spans.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0] <= BROADCAST_IDS
    ready = marked.join(F.broadcast(spans) if small else spans, "id", "left").select("id", "text", "whole", "starts", "ends")
    out = ready.mapInArrow(_prune, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
