"""Masked pseudo-likelihood: a window network predicts every token from both sides; log-probabilities score texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut, small_batches
from chronodiff.llm.textnum import ALNUM, LOWER, chunks, hash_spans, mix, segment_sum, spans

#: A word that occurs so often has a leaf and embeddings of its own; the vocabulary grows with the input.
MIN_COUNT = 50
#: Words on either side that a token is predicted from.
SIDE = 2
#: Windows that the driver starts from: SAMPLE * tokens ** (2 / 3), and LEAST at least (fewer tokens are taken whole).
SAMPLE, LEAST = 6, 200_000
#: Tokens of a part of the pass over all windows, at least; and tokens for each row of the model that the parts move, so that these rows grow no faster than the input.
PART, PER_ROW = 2_000_000, 16
#: Names of the neighbours, from the farthest left to the farthest right.
NEIGHBOURS = [f"l{k}" for k in range(SIDE, 0, -1)] + [f"r{k}" for k in range(1, SIDE + 1)]
#: Width of the hidden layer, windows of a step, windows that a fit sees at least (in two passes or more), its rate.
HIDDEN, STEP, SEEN, RATE = 16, 8192, 600_000, 0.1
#: Columns of a row's change; the last is a node's bias.
MOVED = [f"x{k}" for k in range(HIDDEN + 1)]
#: Tokens scored at once.
SLICE = 16384


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = spans(buf, off, ALNUM)
    return hash_spans(buf, starts, ends).view(np.int64), before


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (hash) and ``n``: how often each word occurs in all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0), 16 << 20):
                word, n = np.unique(_words(buf, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    return docs.select(F.col(f"`{text_col}`")).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Hashes of the words of MIN_COUNT or more, sorted, and their ids: 0 is an edge of a text, words count from 1, the most frequent first, then comes any rarer word."""

    words: np.ndarray
    id: np.ndarray

    @staticmethod
    def of(words: np.ndarray, n: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary of words that occur ``n`` times each, and these numbers by id."""
        first = np.lexsort((words, -n))
        words, n = words[first].astype(np.int64), n[first]
        order = np.argsort(words)
        return Vocabulary(words[order], order + 1), n

    @property
    def rare(self) -> int:
        return len(self.words) + 1

    @cached_property
    def _index(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """A shift that leaves a hash's top bits, the first word of each such bucket, and words and ids with an end; two buckets a word at least, so most hold one or none."""
        bits = len(self.words).bit_length() + 1
        edges = np.arange(-(1 << (bits - 1)), 1 << (bits - 1), dtype=np.int64) << (64 - bits)
        first = np.searchsorted(self.words, edges).astype(np.int32)
        return 64 - bits, first, np.append(self.words, np.iinfo(np.int64).max), np.append(self.id, self.rare)

    def ids(self, h: np.ndarray) -> np.ndarray:
        shift, first, words, ids = self._index
        at = first.take((h >> shift) + len(first) // 2)
        late = np.flatnonzero(words.take(at) < h)
        while len(late):
            at[late] += 1
            late = late[words.take(at[late]) < h[late]]
        return np.where(words.take(at) == h, ids.take(at), self.rare)

    def windows(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the neighbours of every token (a column for each of ``NEIGHBOURS``), and of the token itself."""
        c = self.ids(h)
        text = np.repeat(np.arange(len(before) - 1), np.diff(before))
        around = np.zeros((len(c), 2 * SIDE), c.dtype)
        for k in range(1, min(SIDE, len(c) - 1) + 1):
            same = text[k:] == text[:-k]
            around[k:, SIDE - k] = np.where(same, c[:-k], 0)
            around[:-k, SIDE + k - 1] = np.where(same, c[k:], 0)
        return around, c

    def near(self, c: np.ndarray, place: np.ndarray, left: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What ``windows`` gives for the neighbours of the tokens ``at``: of ids ``c``, each with ``place`` tokens of its text before it and ``left`` after it."""
        around = np.zeros((len(at), 2 * SIDE), c.dtype)
        for k in range(1, SIDE + 1):
            for column, spots, step in ((SIDE - k, np.flatnonzero(place[at] >= k), -k), (SIDE + k - 1, np.flatnonzero(left[at] >= k), k)):
                around[spots, column] = c.take(at[spots] + step)
        return around


def spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes (A-Z lower-cased) with a 0 before, between and after them, and where each word begins."""
    size = ends - starts
    heads = np.cumsum(size + 1) - (size + 1)
    rel = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(int((size + 1).sum()) + 1, np.uint8)
    out[1 + rel + np.repeat(heads, size)] = LOWER[buf[rel + np.repeat(starts, size)]]
    return out, heads


@dataclass
class Tree:
    """A Huffman tree over words: the path of each from the root, as nodes and the side taken (1 or -1).

    Codes are canonical: from left to right the leaves lie ever deeper. So of tokens in the order of
    their leaves (``place``), those that reach a level are the last ones, and those at a node stand together.
    """

    begin: np.ndarray
    node: np.ndarray
    side: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        """The tree of these counts; the bias of a node is the log-odds of its sides, so that it alone gives every word its share."""
        n = len(counts)
        up = np.full(n + max(n - 1, 0), -1)
        heap = [(c, k) for k, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        for k in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = k
            heapq.heappush(heap, (a + b, k))
        depth, at = np.zeros(n, np.int64), up[:n]
        while (at >= 0).any():
            depth += at >= 0
            at = np.where(at >= 0, up[at], -1)
        order = np.lexsort((np.arange(n), -counts, depth))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        size, mass = depth[order], counts[order].astype(float)
        # a code is the sum of the widths of the leaves before it, in units of the deepest level's
        deepest = int(size.max()) if n else 0
        code = np.cumsum(1 << (deepest - size)) - (1 << (deepest - size)) if n else size
        begin = np.concatenate([[0], np.cumsum(depth)])
        node, side, bias, named = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int8), np.zeros(max(n - 1, 0)), 0
        for level in range(deepest):
            low = int(np.searchsorted(size, level, "right"))
            prefix = code[low:] >> (deepest - level)
            right = code[low:] >> (deepest - level - 1) & 1
            own = prefix - prefix[0]
            step = begin[order[low:]] + level
            node[step], side[step] = named + own, 2 * right - 1
            sides = np.bincount(2 * own + right, weights=mass[low:]).reshape(-1, 2)
            bias[named : named + len(sides)] = np.log(sides[:, 1] / sides[:, 0])
            named += len(sides)
        return Tree(begin, node, side, bias, place)

    def in_order(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of words by their leaves, and (in that order) where their paths begin and how long they are."""
        order = _sorted(self.place.take(word))
        begin = self.begin[word[order]]
        return order, begin, self.begin[word[order] + 1] - begin

    def paths(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, side) of each step of the words' paths, and steps before each word."""
        size = self.begin[word + 1] - self.begin[word]
        before = np.concatenate([[0], np.cumsum(size)])
        token = np.repeat(np.arange(len(word)), size)
        at = np.arange(before[-1]) + np.repeat(self.begin[word] - before[:-1], size)
        return token, self.node[at], self.side[at], before


@dataclass
class Model:
    """Vocabulary, tree, network, and log-probabilities of each byte of a rare word after each byte."""

    vocabulary: Vocabulary
    tree: Tree
    par: dict[str, np.ndarray]
    spelling: np.ndarray

    def tokens(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log p(token | neighbours); any rarer word is one token here."""
        out = np.empty(len(token))
        for lo in range(0, len(token), SLICE):
            part = slice(lo, lo + SLICE)
            order, begin, size = self.tree.in_order(token[part] - 1)
            hidden, total = _hidden(self.par, around[part][order]), np.zeros(len(order))
            for level in range(int(size[-1])):
                low = int(np.searchsorted(size, level, "right"))
                node, side = self.tree.node.take(begin[low:] + level), self.tree.side.take(begin[low:] + level)
                z = side * (np.einsum("ij,ij->i", self.par["U"].take(node, axis=0), hidden[low:]) + self.par["b"].take(node))
                total[low:] += np.minimum(z, 0) - np.log(1 + np.exp(-np.abs(z)))
            out[lo + order] = total
        return out

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p of every token of the texts, a rare word's spelling included, and tokens before each text."""
        starts, ends, before = spans(buf, off, ALNUM)
        around, token = self.vocabulary.windows(hash_spans(buf, starts, ends).view(np.int64), before)
        out = self.tokens(around, token)
        rare = np.flatnonzero(token == self.vocabulary.rare)
        if len(rare):
            raw, heads = spelled(buf, starts[rare], ends[rare])
            out[rare] += np.add.reduceat(self.spelling[raw[:-1], raw[1:]], heads)
        return out, before

    @cached_property
    def log_prob(self) -> np.ndarray:
        """log p of every token between any two of the first eight ids (edges beyond them); the last axis is a distribution."""
        k, v = min(8, self.vocabulary.rare + 1), self.vocabulary.rare
        left, right, token = (x.ravel() for x in np.meshgrid(np.arange(k), np.arange(k), np.arange(1, v + 1), indexing="ij"))
        around = np.zeros((len(token), 2 * SIDE), np.int64)
        around[:, SIDE - 1], around[:, SIDE] = left, right
        return self.tokens(around, token).reshape(k, k, v)


def _hidden(par: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = par[NEIGHBOURS[0]].take(around[:, 0], axis=0)
    total += par["c"]
    for k, name in enumerate(NEIGHBOURS[1:], 1):
        total += par[name].take(around[:, k], axis=0)
    return np.tanh(total, out=total)


def window_counts(docs: DataFrame, vocabulary: Vocabulary, share: float, text_col: str) -> DataFrame:
    """``NEIGHBOURS``, ``token`` and ``n``: a share of all windows, and with a first neighbour of -1 the pairs of bytes of all rare words (in the second and in ``token``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [*NEIGHBOURS, "token"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = shared.value, np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                starts, ends, before = spans(buf, off, ALNUM)
                h = hash_spans(buf, starts, ends)
                token = own.ids(h.view(np.int64))
                rare = token == own.rare
                raw, _ = spelled(buf, starts[rare], ends[rare])
                pairs += np.bincount(raw[:-1].astype(np.int64) * 256 + raw[1:], minlength=1 << 16)
                size = np.diff(before)
                place = np.arange(len(h)) - np.repeat(before[:-1], size)
                around = np.roll(h, 1) * np.uint64(3) + np.roll(h, -1) * np.uint64(5)
                drawn = np.flatnonzero((mix(h + around + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) < np.uint64(share * 2**53))
                near = own.near(token, place, np.repeat(size, size) - 1 - place, drawn)
                cols = [x.astype(np.int32) for x in (*near.T, token[drawn])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.ones(len(cols[0]), np.int64))], [*names, "n"])
        at = np.flatnonzero(pairs)
        cols = [np.full(len(at), -1), at >> 8, *[np.zeros(len(at))] * (2 * SIDE - 2), at & 255]
        yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in cols], pa.array(pairs[at])], [*names, "n"])

    got = docs.select(F.col(f"`{text_col}`")).mapInArrow(work, ", ".join(f"{c} int" for c in names) + ", n long")
    return got.groupBy(*names).agg(F.sum("n").alias("n"))


def fit_spelling(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next byte (0: the end) after each byte (0: the start), from counts plus one."""
    p = pairs + 1.0
    p[0, 0] = 1e-9  # no word is empty
    return np.log(p / p.sum(axis=1, keepdims=True))


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The order of rows, equal ones as they come; numbers sort faster than places."""
    n = max(len(rows), 1)
    return np.sort(rows * np.int64(n) + np.arange(len(rows))) % n


def _step(x: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """An Adagrad step on the rows, sorted, that have gradients; equal rows are summed first."""
    head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    if len(head) < len(rows):
        rows, grad = rows[head], np.add.reduceat(grad, head, axis=0)
    now = seen.take(rows) + (np.einsum("ij,ij->i", grad, grad) / grad.shape[1] if grad.ndim > 1 else grad * grad)
    seen[rows] = now
    rate = RATE / (np.sqrt(now) + 1e-8)
    x[rows] = x.take(rows, axis=0) - grad * (rate[:, None] if grad.ndim > 1 else rate)


def _fit_windows(par: dict[str, np.ndarray], seen: dict[str, np.ndarray], tree: Tree, around: np.ndarray, token: np.ndarray, n: np.ndarray) -> None:
    """One step on windows that occur ``n`` times each; changes ``par`` and ``seen`` (its sums of squared gradients).

    The tree is walked level by level, and a node lies on one level, so each level's nodes move as soon as it is done.
    """
    order, begin, size = tree.in_order(token - 1)
    around, n = around.take(order, axis=0), n.take(order)
    hidden = _hidden(par, around)
    back = np.zeros_like(hidden)
    for level in range(int(size[-1])):
        low = int(np.searchsorted(size, level, "right"))
        node, side = tree.node.take(begin[low:] + level), tree.side.take(begin[low:] + level)
        u = par["U"].take(node, axis=0)
        z = side * (np.einsum("ij,ij->i", u, hidden[low:]) + par["b"].take(node))
        g = -side * n[low:] / (1 + np.exp(np.minimum(z, 60)))
        u *= g[:, None]
        back[low:] += u
        _step(par["U"], seen["U"], node, g[:, None] * hidden[low:])
        _step(par["b"], seen["b"], node, g)
    back *= 1 - hidden * hidden
    for k, name in enumerate(NEIGHBOURS):
        order = _sorted(around[:, k])
        _step(par[name], seen[name], around[order, k], back.take(order, axis=0))
    _step(par["c"][None], seen["c"], np.zeros(1, np.int64), back.sum(axis=0)[None])


def fit_network(tree: Tree, ids: int, around: np.ndarray, token: np.ndarray, n: np.ndarray, seed: int = 3) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """A network fitted to windows that occur ``n`` times each, and its sums of squared gradients.

    hidden = tanh(sum of an embedding of each neighbour, one table a place, + c); each node on a token's path decides
    its side by sigmoid(U[node] hidden + b[node]). Biases start from the counts
    of the whole corpus.
    """
    rng = np.random.default_rng(seed)
    nodes = len(tree.bias)
    par = {c: rng.normal(0, 0.3 / np.sqrt(SIDE), (ids, HIDDEN)) for c in NEIGHBOURS}
    par |= {"c": np.zeros(HIDDEN), "U": np.zeros((nodes, HIDDEN)), "b": tree.bias}
    par = {k: x.astype(np.float32) for k, x in par.items()}
    seen = {k: np.full(len(par[k]) if k != "c" else 1, 1e-2, np.float32) for k in par}
    if not nodes or not len(n):
        return par, seen
    for _ in range(max(2, -(-SEEN // len(n)))):
        order = rng.permutation(len(n))
        for lo in range(0, len(n), STEP):
            at = order[lo : lo + STEP]
            _fit_windows(par, seen, tree, around[at], token[at], n[at])
    return par, seen


def _moved(t: int, at: np.ndarray, w: np.ndarray, delta: np.ndarray) -> pa.RecordBatch:
    """Rows ``at`` of table ``t``, their weights, and their changes times these."""
    weighted = [pa.array(np.ascontiguousarray(x)) for x in (delta * w[:, None]).T]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), pa.array(w), *weighted], ["t", "at", "w", *MOVED])


def _dealt(docs: DataFrame, parts: int, text_col: str) -> DataFrame:
    """``text`` and ``n`` (rows that have it), in ``parts`` tasks into however many partitions the session deals the texts."""
    text = F.col(f"`{text_col}`").alias("text")
    dealt = docs.select(text).where(F.col("text").isNotNull()).repartition(parts, "text").groupBy("text").agg(F.count("*").alias("n"))
    return dealt.sortWithinPartitions(F.xxhash64("text"), "text").select("text", "n").coalesce(parts)


def fit_all(docs: DataFrame, vocabulary: Vocabulary, tree: Tree, par: dict[str, np.ndarray], seen: dict[str, np.ndarray], parts: int, text_col: str) -> dict[str, np.ndarray]:
    """The network after a pass over every window of all texts.

    Texts are dealt to ``parts`` and ordered by their hash, so files' layout does not
    change the pass; equal texts are one with their number as weight. A part is one task, as
    each gives all rows that it moved. Each part goes
    on from the same start, and each row of a table becomes the mean of what the
    parts made of it, weighted by the windows that moved it there.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, tree, par, seen))
    names = [*NEIGHBOURS, "U"]  # "U" with "b" as one column more, and "c" as a row of its own after them

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tree, start, squares = shared.value
        par, seen = ({k: x.copy() for k, x in d.items()} for d in (start, squares))
        moved, said = {k: np.zeros(len(par[k])) for k in NEIGHBOURS}, np.zeros(len(tree.begin) - 1)
        total, rng = 0.0, np.random.default_rng(5)
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(0)):
                h, before = _words(buf, off)
                around, token = vocabulary.windows(h, before)
                n = np.repeat(batch.column(1).slice(lo, hi - lo).to_numpy(), np.diff(before)).astype(np.float32)
                order = rng.permutation(len(token))
                for at in np.array_split(order, -(-len(order) // STEP)) if len(order) else ():
                    _fit_windows(par, seen, tree, around[at], token[at], n[at])
                total += float(n.sum())
                for k, name in enumerate(NEIGHBOURS):
                    moved[name] += np.bincount(around[:, k], weights=n, minlength=len(moved[name]))
                said += np.bincount(token - 1, weights=n, minlength=len(said))
        own, node, _, _ = tree.paths(np.arange(len(said)))
        moved["U"] = np.bincount(node, weights=said[own], minlength=len(par["U"]))
        for t, name in enumerate(names):
            at = np.flatnonzero(moved[name])
            delta = par[name][at] - start[name][at]
            last = par["b"][at] - start["b"][at] if name == "U" else np.zeros(len(at))
            yield _moved(t, at, moved[name][at], np.column_stack([delta, last]))
        if total:
            yield _moved(len(names), np.zeros(1, np.int64), np.array([total]), np.append(par["c"] - start["c"], 0)[None])

    got = _dealt(docs, parts, text_col).mapInArrow(work, "t int, at long, w double, " + ", ".join(f"{c} double" for c in MOVED))
    mean = got.groupBy("t", "at").agg(*[(F.sum(c) / F.sum("w")).cast("float").alias(c) for c in MOVED]).toArrow()
    out = {k: x.copy() for k, x in par.items()}
    table, at, delta = mean["t"].to_numpy(), mean["at"].to_numpy(), np.stack([mean[c].to_numpy() for c in MOVED], axis=1)
    for t, name in enumerate(names):
        out[name][at[table == t]] += delta[table == t, :HIDDEN]
    out["b"][at[table == len(names) - 1]] += delta[table == len(names) - 1, HIDDEN]
    out["c"] += delta[table == len(names), :HIDDEN].sum(axis=0)
    return out


def part_count(total: int, vocabulary: Vocabulary) -> int:
    """Parts of the pass over ``total`` windows: each moves most rows of all tables, so together they are held to a share of the input."""
    rows = (len(NEIGHBOURS) + 1) * (vocabulary.rare + 1)
    return max(1, min(-(-total // PART), total // (PER_ROW * rows)))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A network fitted to windows of all texts.

    Words are counted over the whole corpus. Each word of ``MIN_COUNT`` or more
    is predicted itself: as a leaf of a tree whose decisions see
    ``SIDE`` words on either side. Any rarer word is predicted as rare and then byte by byte, from
    the spelling of all rare words of the corpus, so texts with words never
    seen have a probability too. (Spelling could also give a frequent word, so
    the probabilities of all words sum to a little less than 1.) The driver
    gathers the vocabulary and makes a start from a sample of the windows; both
    grow with the input, more slowly than the input. If there are more windows,
    a pass over all of them follows in tasks (``fit_all``).
    """
    small_batches(docs.sparkSession)
    counted = cut(word_counts(docs, text_col), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.where(F.col("n") >= MIN_COUNT).toArrow()
    vocabulary, n = Vocabulary.of(top["word"].to_numpy(), top["n"].to_numpy())
    tree = Tree.of(np.append(n, max(total - n.sum(), 1)).astype(float))
    share = min(1.0, max(LEAST, SAMPLE * total ** (2 / 3)) / max(total, 1))
    got = window_counts(docs, vocabulary, share, text_col).toArrow()
    around, token, n = np.stack([got[c].to_numpy() for c in NEIGHBOURS], axis=1), got["token"].to_numpy(), got["n"].to_numpy()
    pairs, byte = np.zeros((256, 256)), around[:, 0] < 0
    pairs[around[byte, 1], token[byte]] = n[byte]
    order = np.lexsort((token, *around.T))
    order = order[~byte[order]]
    par, seen = fit_network(tree, vocabulary.rare + 1, around[order], token[order].astype(np.int64), n[order].astype(np.float32))
    if share < 1 and len(tree.bias):
        par = fit_all(docs, vocabulary, tree, par, seen, part_count(total, vocabulary), text_col)
    return Model(vocabulary, tree, par, fit_spelling(pairs))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``log_prob`` (sum over tokens) and ``mean_log_prob`` of every whole text.

    Defined cases: a text without words (null, empty, marks only) has no tokens
    and both values 0; repeated rows are scored each, and equal texts alike, so
    that ties stay ties;
    other columns are not read; a very long text is scored whole, with some 100
    bytes of memory a byte of it in its task; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                each, before = shared.value.texts(buf, off)
                n, total = np.diff(before), segment_sum(each, before)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], ["id", "n_tokens", "log_prob", "mean_log_prob"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_tokens long, log_prob double, mean_log_prob double").withColumnRenamed("id", id_col)
