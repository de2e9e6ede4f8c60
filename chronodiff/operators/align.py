"""Ordered differences between two versions: block script, word script, changed text, marked-up lines (Arrow batches)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from operator import lt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token of a word script with the white space after it, so that tokens put together are the text.
TOKEN = re.compile(r"(?:\w+(?:[.,'’]\w+)*|[^\w\s])\s*|\s+")
WORDS = re.compile(r"\w+")
#: Beyond these sizes no word script is made; blocks are aligned all the same and ``degraded`` is set (fixed values).
MAX_BLOCKS, MAX_TOKENS = 20_000, 5_000

OP_NAMES = ["op", "t", "old_lo", "old_hi", "new_lo", "new_hi", "tokens", "old_texts", "new_texts", "added_words", "removed_words", "degraded"]
OP = ("op int, t string, old_lo int, old_hi int, new_lo int, new_hi int, tokens array<struct<k:string,text:string>>, "
      "old_texts array<string>, new_texts array<string>, added_words int, removed_words int, degraded boolean")


def common_subsequence(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both of a longest common subsequence of two rows of integers.

    Divide and conquer over the lengths of best alignments of the two halves.
    A row of those lengths is one number of as many bits as ``y`` is long: bit
    j says that the best alignment does not grow at j, and one addition carries
    a whole row on. So a step costs len(y) / 64 machine words, whatever the
    number of differences, and memory stays linear.
    """
    pairs: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and x[a] == y[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            spot = np.flatnonzero(y[c:d] == x[a])
            pairs += [(a, c + int(spot[0]))] if len(spot) else []
            continue
        mid = (a + b) // 2
        front = _grown(x[a:mid], y[c:d])
        back = _grown(x[mid:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int(np.argmax(front + back))
        work += [(a, mid, c, cut), (mid, b, cut, d)]
    out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _grown(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` and each prefix of ``y``, the empty one first."""
    n = len(y)
    masks: dict[int, int] = {}
    wanted = set(x.tolist())
    order = np.argsort(y, kind="stable")
    values, heads = np.unique(y[order], return_index=True)
    for value, spots in zip(values.tolist(), np.split(order, heads[1:]), strict=True):
        if value in wanted:
            bits = np.zeros(n, np.uint8)
            bits[spots] = 1
            masks[value] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << n) - 1
    row = full
    for value in x.tolist():
        if (mask := masks.get(value)) is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(eq | del | ins | rep, a_lo, a_hi, b_lo, b_hi), ends exclusive; a shortest script of insertions and deletions."""
    n, m = len(a), len(b)
    lo, least = 0, min(n, m)
    while lo < least and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < least - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    i, j = _once_each(a, b, lo, n - end, m - end) or _numbered(a, b, lo, n - end, m - end)
    if not len(i) and not lo and not end:
        return [("rep" if n and m else "del" if n else "ins", 0, n, 0, m)] if n or m else []
    p, q = [*range(lo), *i, *range(n - end, n + 1)], [*range(lo), *j, *range(m - end, m + 1)]
    # runs of pairs that follow each other on both sides, the end of both sides last
    if len(p) < 512:
        heads = [0] + [k for k in range(1, len(p)) if p[k] != p[k - 1] + 1 or q[k] != q[k - 1] + 1]
    else:
        heads = [0, *(np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1).tolist()]
    lasts = [k - 1 for k in heads[1:]] + [len(p) - 1]
    out, at, to = [], 0, 0
    for first, last in zip(heads, lasts, strict=True):
        u, v, x, y = p[first], q[first], p[last], q[last]
        if u > at or v > to:
            out.append(("rep" if u > at and v > to else "del" if u > at else "ins", at, u, to, v))
        at, to = min(x + 1, n), min(y + 1, m)
        if at > u and to > v:
            out.append(("eq", u, at, v, to))
    return out


def _once_each(a: list[str], b: list[str], lo: int, a_end: int, b_end: int) -> tuple[list[int], list[int]] | None:
    """Pairs of a longest common subsequence where no common text repeats: the longest increasing row of positions."""
    where = {t: k for k, t in enumerate(b[lo:b_end], lo)}
    if len(where) < b_end - lo:
        return None
    i = [k for k, t in enumerate(a[lo:a_end], lo) if t in where]
    j = [where[a[k]] for k in i]
    if all(map(lt, j, j[1:])):
        return i, j
    if len(set(j)) < len(j):
        return None
    tops: list[int] = []  # the least last position of increasing rows, by their length
    ends: list[int] = []
    before = [-1] * len(j)
    for k, spot in enumerate(j):
        n = bisect_left(tops, spot)
        before[k] = ends[n - 1] if n else -1
        if n == len(tops):
            tops.append(spot)
            ends.append(k)
        else:
            tops[n], ends[n] = spot, k
    row, k = [], ends[-1]
    while k >= 0:
        row.append(k)
        k = before[k]
    row.reverse()
    return [i[k] for k in row], [j[k] for k in row]


def _numbered(a: list[str], b: list[str], lo: int, a_end: int, b_end: int) -> tuple[list[int], list[int]]:
    """Pairs of a longest common subsequence of texts that may repeat."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (a[lo:a_end], b[lo:b_end]))
    # what one side alone has can match nothing, and is left out of the search
    i, j = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    p, q = common_subsequence(x[i], y[j])
    return (lo + i[p]).tolist(), (lo + j[q]).tolist()


def word_script(old: str, new: str) -> tuple[list[tuple[str, str]], bool]:
    """(eq | del | ins, text) and whether it is too long for a script: tokens compared without regard to case, texts as they are.

    ``eq`` and ``ins`` texts put together are the new text; where the old
    text's ``eq`` differs in case or white space, the new one stands for it.
    """
    a, b = TOKEN.findall(old), TOKEN.findall(new)
    if len(a) > MAX_TOKENS or len(b) > MAX_TOKENS:
        return [("del", old), ("ins", new)], True
    out = []
    for t, i, p, j, q in edit_script([x.strip().casefold() for x in a], [x.strip().casefold() for x in b]):
        if t == "eq":
            out.append(("eq", "".join(b[j:q])))
        else:
            out += [("del", "".join(a[i:p]))] * (p > i) + [("ins", "".join(b[j:q]))] * (q > j)
    return out, False


def count_words(texts: list[str]) -> int:
    return sum(len(WORDS.findall(t)) for t in texts)


def _moved(script: list[tuple], old: list[str], new: list[str]) -> dict[int, int]:
    """New position to old position of blocks that go in one place and come in another: the n-th that goes is the n-th that comes."""
    def numbered(texts: list[str], spots: Iterator[int]) -> dict[tuple[str, int], int]:
        seen: Counter = Counter()
        out = {}
        for k in spots:
            out[texts[k], seen[texts[k]]] = k
            seen[texts[k]] += 1
        return out

    went = numbered(old, (k for t, i, p, _, _ in script if t != "eq" for k in range(i, p)))
    came = numbered(new, (k for t, _, _, j, q in script if t != "eq" for k in range(j, q)))
    return {came[name]: went[name] for name in came.keys() & went.keys()}


def block_script(old: list[str], new: list[str], moves: bool = True) -> list[tuple]:
    """(t, old_lo, old_hi, new_lo, new_hi, tokens, old texts, new texts, words that came, words that went, degraded), ranges inclusive.

    A side without blocks has -1. A block that goes in one place and comes in
    another is ``mov`` and no change, unless ``moves`` is off. Replaced runs
    get a word script: block by block where both sides have as many, else over
    the run. A page of more than ``MAX_BLOCKS`` blocks, or a run of more than
    ``MAX_TOKENS`` tokens, gets none: all words of both its sides count.
    """
    script = edit_script(old, new)
    huge = max(len(old), len(new)) > MAX_BLOCKS
    moved = _moved(script, old, new) if moves else {}
    left = set(moved.values())
    out = []
    for t, i, p, j, q in script:
        if t == "eq":
            out.append(("eq", i, p - 1, j, q - 1, [], [], [], 0, 0, False))
            continue
        a, b = [k for k in range(i, p) if k not in left], [k for k in range(j, q) if k not in moved]
        out += [("mov", moved[k], moved[k], k, k, [], [], [new[k]], 0, 0, False) for k in range(j, q) if k in moved]
        went, came = [old[k] for k in a], [new[k] for k in b]
        if a and b:
            tokens, degraded = _run_script(went, came) if not huge else ([], True)
            if degraded:
                n_ins, n_del = count_words(came), count_words(went)
            else:
                n_ins, n_del = (count_words([text for k, text in tokens if k == kind]) for kind in ("ins", "del"))
            out.append(("rep", a[0], a[-1], b[0], b[-1], tokens, went, came, n_ins, n_del, degraded))
        elif a:
            out.append(("del", a[0], a[-1], -1, -1, [], went, [], 0, count_words(went), False))
        elif b:
            out.append(("ins", -1, -1, b[0], b[-1], [], [], came, count_words(came), 0, False))
    return out


def _run_script(went: list[str], came: list[str]) -> tuple[list[tuple[str, str]], bool]:
    if len(went) != len(came):
        return word_script("\n".join(went), "\n".join(came))
    tokens, degraded = [], False
    for k, (x, y) in enumerate(zip(went, came, strict=True)):
        own, coarse = word_script(x, y)
        tokens += [("eq", "\n")] * (k > 0) + own
        degraded |= coarse
    return tokens, degraded


def _per_pair(pairs: DataFrame, keys: list[str], names: list[str], schema: str, make: Callable[[list[str], list[str]], list[tuple]]) -> DataFrame:
    """``make``'s rows for each pair (``old_blocks``, ``new_blocks``). A pair is one row, so no shuffle and no group; nulls count as no blocks."""
    kinds = dict(pairs.dtypes)
    full = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 64):  # rows of a script can be many
                part = frame.iloc[lo : lo + 64]
                rows = []
                for own, old, new in zip(part[keys].itertuples(index=False, name=None), part["old_blocks"], part["new_blocks"], strict=True):
                    rows += [(*own, *r) for r in make(*(list(x) if x is not None else [] for x in (old, new)))]
                yield pd.DataFrame(rows, columns=[*keys, *names])

    return pairs.select(*keys, "old_blocks", "new_blocks").mapInPandas(work, full)


def changed_words(old: list[str], new: list[str]) -> int:
    """Words that came or went; of a replaced run the larger side counts."""
    return sum(max(r[8], r[9]) for r in block_script(old, new))


def align_blocks(pairs: DataFrame, keys: list[str], moves: bool = True) -> DataFrame:
    """``keys`` and one row for each operation of each pair: see ``block_script``."""

    def make(old: list[str], new: list[str]) -> list[tuple]:
        return [(n, *r[:5], [{"k": k, "text": t} for k, t in r[5]], *r[6:]) for n, r in enumerate(block_script(old, new, moves))]

    return _per_pair(pairs, keys, OP_NAMES, OP, make)


def diff_stats(ops: DataFrame, keys: list[str], ignore_removed: bool = False) -> DataFrame:
    """Per pair: words that came, went and changed (of a replaced run the larger side), changed, inserted and deleted blocks, and ``degraded``."""
    changed = F.col("added_words") if ignore_removed else F.greatest("added_words", "removed_words")
    blocks = F.when(F.col("t") == "mov", 0).otherwise(F.greatest(F.size("old_texts"), F.size("new_texts")))
    side = lambda texts: F.sum(F.when(F.col("t").isin("eq", "mov"), 0).otherwise(F.size(texts)))
    return ops.groupBy(*keys).agg(
        F.sum("added_words").alias("added_words"), F.sum("removed_words").alias("removed_words"), F.sum(changed).alias("changed_words"),
        F.sum(blocks).alias("changed_blocks"), side("new_texts").alias("inserted_blocks"), side("old_texts").alias("deleted_blocks"), F.max("degraded").alias("degraded"),
    )


def _marked(script: list[tuple], old: list[str], new: list[str], context: int) -> list[str]:
    lines = []
    wrap = {"eq": "{}", "del": "[-{}-]", "ins": "{{+{}+}}"}
    for t, _, _, j, q, tokens, went, came, *_ in script:
        if t == "eq":
            own = [f"  {x}" for x in new[j : q + 1]]
            lines += own if len(own) <= 2 * context + 1 else [*own[:context], "  …", *own[-context:]]
        elif t == "mov":
            lines.append(f"> {new[j]}")
        elif t == "rep" and tokens:
            text = "".join(wrap[k].format(x.rstrip()) + x[len(x.rstrip()) :] for k, x in tokens)
            lines += [f"~ {x.rstrip()}" for x in text.split("\n")]
        else:
            lines += [f"- {x}" for x in went] + [f"+ {x}" for x in came]
    return lines


def render_marks(pairs: DataFrame, keys: list[str], context: int = 2) -> DataFrame:
    """``keys``, ``n``, ``line``: two spaces same, ``+`` came, ``-`` went, ``>`` moved, ``~`` edited with [-old-]{+new+}."""
    return _per_pair(pairs, keys, ["n", "line"], "n int, line string", lambda old, new: list(enumerate(_marked(block_script(old, new), old, new, context))))


def changed_text(ops: DataFrame) -> DataFrame:
    """Operations with ``added`` and ``removed`` text: whole blocks where blocks came or went, changed tokens where blocks were edited."""

    def side(kind: str, whole: str) -> Column:
        tokens = F.transform(F.filter("tokens", lambda x: x["k"] == kind), lambda x: F.rtrim(x["text"]))
        return F.when(F.col("t") == "mov", "").when(F.size("tokens") > 0, F.array_join(tokens, " ")).otherwise(F.array_join(whole, "\n"))

    return ops.withColumn("added", side("ins", "new_texts")).withColumn("removed", side("del", "old_texts"))


def gate_cumulative(versions: DataFrame, page: str, at: str, min_words: int) -> DataFrame:
    """``page``, ``at``, ``words``, ``alert``, ``checks``: word changes against an anchor that moves on an alert.

    Each version is compared with the last that raised an alert (the first
    version at the start); of a replaced run the larger side counts. A page's
    versions are one group, as each verdict depends on the one before.
    """
    kinds = dict(versions.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        rows, anchor, checks = [], None, 0
        for own, when, blocks in zip(frame[page], frame[at], frame["blocks"], strict=True):
            blocks = list(blocks) if blocks is not None else []
            if anchor is None:
                anchor = blocks
                continue
            checks += 1
            words = changed_words(anchor, blocks)
            rows.append((own, when, words, words >= min_words, checks))
            if words >= min_words:
                anchor, checks = blocks, 0
        return pd.DataFrame(rows, columns=[page, at, "words", "alert", "checks"])

    return versions.select(page, at, "blocks").groupBy(page).applyInPandas(fold, f"{page} {kinds[page]}, {at} {kinds[at]}, words int, alert boolean, checks int")
