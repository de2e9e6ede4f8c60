"""Exact top-k by inner product: best-first search in M-trees, one for each block of vectors.

Inner products become distances: a vector gets one more coordinate that fills
its length up to the longest one, a query gets zero there. Then the squared
distance is a constant less twice the inner product, and the triangle
inequality holds for it.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronodiff.llm.tables import cut, small_batches

#: Different vectors of a block, on average, until there are as many blocks; from then on both grow with the root.
BLOCK = 4096
#: Vectors that the cells' centres are fitted on, about: so many, and so many a cell.
SAMPLE, SAMPLE_PER_CELL = 20_000, 8
#: Entries of a leaf page, and of an inner page.
LEAF, INNER = 64, 24
#: Queries that one task holds against one block's tree.
QUERIES = 1024
#: Inner products below this are exact in double precision.
EXACT = 1 << 53


def cells_for(n: int) -> int:
    """Cells for n vectors: of ``BLOCK`` each, and the root of n of them beyond ``BLOCK ** 2`` vectors."""
    return max(1, min(n // BLOCK, int(np.sqrt(n))) if n > BLOCK * BLOCK else n // BLOCK)


def _filled(x: np.ndarray, longest: int) -> np.ndarray:
    """Vectors with the coordinate that fills their squared length up to ``longest``."""
    y = x.astype(np.float64)
    return np.concatenate([y, np.sqrt(np.maximum(longest - (y * y).sum(axis=1), 0))[:, None]], axis=1)


def _apart(y: np.ndarray, one: np.ndarray) -> np.ndarray:
    d = y - one
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Tree:
    """Pages of an M-tree over the rows of one matrix, in the order of its leaf pages.

    An inner page's entry has a routing row, the covering radius of what is
    below it, the distance to its page's own routing row, and a child page. A
    leaf page is a range of rows with their distances to its routing row.
    """

    FIELDS = ("x", "longest", "leaf", "low", "high", "to_parent", "entry_row", "radius", "entry_parent", "child", "root")

    def __init__(self, **fields):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.longest = int(self.longest)
        top = int(np.abs(self.x).max(initial=0))
        self.top, self.fast = top, self.x.astype(np.float64) if top < 1 << 26 else None
        self.computed = 0

    @classmethod
    def build(cls, x: np.ndarray, longest: int) -> tuple[Tree, np.ndarray]:
        """(tree, order of the given rows in it): pages by sampled routing rows, each row to its nearest."""
        y, rng = _filled(x, longest), np.random.default_rng(11)
        root = int(_apart(y, y.mean(axis=0)).argmin())
        leaf, low, high, order = [], [], [], []
        entry = {"row": [], "radius": [], "parent": [], "child": []}
        to_parent = np.zeros(len(x))
        todo = [(np.arange(len(x)), root)]
        at = 0
        while at < len(todo):  # pages in order of their numbers; a page's entries lie together
            rows, route = todo[at]
            at += 1
            if len(rows) <= LEAF:
                leaf.append(True)
                low.append(len(order))
                order += rows.tolist()
                high.append(len(order))
                to_parent[rows] = _apart(y[rows], y[route])
                continue
            routes = rng.choice(rows, min(INNER, -(-len(rows) // LEAF) + 1), replace=False)
            near = np.stack([_apart(y[rows], y[r]) for r in routes])
            home, dist = near.argmin(axis=0), near.min(axis=0)
            parts = [(routes[k], rows[home == k], dist[home == k]) for k in range(len(routes)) if (home == k).any()]
            if len(parts) == 1:  # too close together to tell apart: by halves
                parts = [(p[0], p, _apart(y[p], y[p[0]])) for p in np.array_split(rows, 2)]
            leaf.append(False)
            low.append(len(entry["row"]))
            for r, own, d in parts:
                entry["row"].append(r)
                entry["radius"].append(d.max())
                entry["parent"].append(_apart(y[[r]], y[route])[0])
                entry["child"].append(len(todo))
                todo.append((own, r))
            high.append(len(entry["row"]))
        order = np.array(order, np.int64)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        radius = _apart(y, y[root]).max()
        tree = cls(
            x=x[order], longest=longest, leaf=np.array(leaf), low=np.array(low), high=np.array(high), to_parent=to_parent[order],
            entry_row=place[np.array(entry["row"], np.int64)], radius=np.array(entry["radius"]), entry_parent=np.array(entry["parent"]),
            child=np.array(entry["child"], np.int64), root=np.array([place[root], radius]),
        )
        return tree, order

    def dump(self) -> bytes:
        out = BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(BytesIO(data)) as got:
            return cls(**{name: got[name] for name in cls.FIELDS})

    def search(self, q: np.ndarray, k: int, ids: list[list[int]], own: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) for ``q``, smaller ids first among equal scores; none below ``least``.

        Pages are taken in order of the least distance that anything in them can
        have. A row or page whose distance cannot be small enough by the stored
        distances to its parent is passed over without computing its own.
        """
        squared = int((q.astype(object) ** 2).sum()) if len(q) else 0
        exact = self.fast is not None and self.top * int(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT
        x, v = (self.fast, q.astype(np.float64)) if exact else (self.x, q)
        slack = 1e-7 * (np.sqrt(self.longest) + np.sqrt(squared)) + 1e-6  # rounding of stored distances
        far = lambda score: np.sqrt(np.maximum(float(squared + self.longest) - 2.0 * score, 0))
        best: list[tuple[int, int]] = []
        limit = np.inf if least is None else far(least) + slack
        first = far(float(x[int(self.root[0])] @ v)) if len(self.x) else 0.0
        queue = [(max(first - self.root[1], 0.0), 0, first)]
        while queue:
            low, page, to_route = heappop(queue)
            if low > limit:
                break
            a, b = self.low[page], self.high[page]
            if not self.leaf[page]:
                near = np.abs(to_route - self.entry_parent[a:b]) - self.radius[a:b] <= limit
                some = np.flatnonzero(near) + a
                dist = far((x[self.entry_row[some]] @ v).astype(np.float64))
                self.computed += len(some)
                bound = np.maximum(dist - self.radius[some], 0)
                for e, d, lb in zip(some.tolist(), dist.tolist(), bound.tolist(), strict=True):
                    if lb <= limit:
                        heappush(queue, (lb, int(self.child[e]), d))
                continue
            some = np.flatnonzero(np.abs(to_route - self.to_parent[a:b]) <= limit) + a
            scores = x[some] @ v
            self.computed += len(some)
            good = scores >= (best[0][0] if len(best) == k else -np.inf if least is None else least)
            for row, score in zip(some[good].tolist(), scores[good].tolist(), strict=True):
                for name in ids[row]:
                    found = (int(score), -name)
                    if name == own or (least is not None and found[0] < least):
                        continue
                    if len(best) < k:
                        heappush(best, found)
                    elif found > best[0]:
                        heapreplace(best, found)
                    else:
                        break  # the row's later ids are larger still
            if len(best) == k:
                limit = min(limit, far(best[0][0]) + slack)
        return [(score, -name) for score, name in sorted(best, reverse=True)]


def fit_cells(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centres of at most k cells, by k-means."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:k]]
    for _ in range(rounds):
        nearest = _nearest(sample, centres)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(y), np.int64), (centres * centres).sum(axis=1) / 2
    for at in range(0, len(y), 512):
        out[at : at + 512] = (y[at : at + 512] @ centres.T - half).argmax(axis=1)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _whole(scale: int):
    """(id, vector) to (id, dim, raw, squared): whole numbers; rows that take no part go."""

    def work(batches):
        for batch in batches:
            vecs = batch.column(1)
            offsets = vecs.offsets.to_numpy().astype(np.int64)
            flat = vecs.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            offsets = offsets - offsets[0]
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            fine = np.flatnonzero(np.array(vecs.is_valid()) & (count(~np.isfinite(flat)) == 0) & np.array(batch.column(0).is_valid()))
            with np.errstate(invalid="ignore", over="ignore"):
                down = np.floor(scale * np.nan_to_num(flat, posinf=0, neginf=0))
            size = np.add.reduceat(np.append(down * down, 0.0), offsets[:-1]) * (np.diff(offsets) > 0) if len(offsets) > 1 else np.zeros(0)
            if (size[fine] >= 2.0**62).any():
                raise ArithmeticError("vectors too long: their scores leave a 64-bit integer")
            data = down.astype("<i8", casting="unsafe").tobytes()
            raw = [data[8 * offsets[k] : 8 * offsets[k + 1]] for k in fine.tolist()]
            whole = np.array([int(np.frombuffer(r, "<i8") @ np.frombuffer(r, "<i8")) for r in raw], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(fine)), pa.array(np.diff(offsets)[fine], pa.int32()), pa.array(raw, pa.binary()), pa.array(whole)], ["id", "dim", "raw", "squared"]
            )

    return work


def _assign(centres, longest: dict[int, int]):
    def work(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                y, at = _filled(_matrix(own.column("raw"), dim), longest[dim]), centres.value.get(dim)
                cell = _nearest(y, at) if at is not None else np.zeros(len(y), np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell)], [*own.schema.names, "cell"])

    return work


def _grow(longest: dict[int, int]):
    def work(table: pa.Table) -> pa.Table:
        dim, cell, part = (table[c][0].as_py() for c in ("dim", "cell", "part"))
        x = _matrix(table["raw"], dim)
        tree, order = Tree.build(x, longest[dim])
        ids = table["ids"].combine_chunks().take(pa.array(order))
        centre = x[order[int(tree.root[0])]].tobytes()
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": [cell], "part": pa.array([part], pa.int32()), "centre": [centre], "radius": [float(tree.root[1])], "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))), "tree": pa.array([tree.dump()], pa.binary())})

    return work


def _route(roots, longest: dict[int, int], nearest: bool):
    """The blocks that each query has to look into: the nearest, or all others that can hold a good enough vector."""

    def work(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                if dim not in roots.value:
                    continue
                block, centre, radius = roots.value[dim]
                q = _matrix(own.column("raw"), dim).astype(np.float64)
                squared = own.column("squared").to_numpy().astype(np.float64)
                picked = []
                for at in range(0, len(q), 256):
                    room = squared[at : at + 256, None] + longest[dim]
                    dist = np.sqrt(np.maximum(room - 2 * (q[at : at + 256] @ centre.T), 0)) - radius
                    if nearest:
                        hit = np.zeros(dist.shape, bool)
                        hit[np.arange(len(dist)), dist.argmin(axis=1)] = True
                    else:
                        least = own.column("least").slice(at, 256).cast(pa.float64()).fill_null(-np.inf).to_numpy()
                        home = own.column("block").slice(at, 256).to_numpy()
                        with np.errstate(invalid="ignore"):
                            limit = np.where(np.isinf(least), np.inf, np.sqrt(np.maximum(room[:, 0] - 2 * least, 0)))
                        slack = 1e-7 * (np.sqrt(squared[at : at + 256]) + np.sqrt(longest[dim])) + 1e-6
                        hit = (dist <= (limit + 2 * slack)[:, None]) & (block[None, :] != home[:, None])
                    picked.append(np.stack(np.nonzero(hit)) + np.array([[at], [0]]))
                rows, blocks = np.concatenate(picked, axis=1)
                cols = [own.column(c).take(pa.array(rows)) for c in ("row", "id", "dim", "raw", "squared", "least")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(block[blocks])], ["row", "id", "dim", "raw", "squared", "least", "block"])

    return work


def _look(k: int):
    def work(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and trees.num_rows:
            tree, ids = Tree.load(trees["tree"][0].as_py()), trees["ids"][0].as_py()
            q = _matrix(queries["raw"], tree.x.shape[1])
            for row, own, least, block, v in zip(*(queries[c].to_pylist() for c in ("row", "id", "least", "block")), q, strict=True):
                out += [(row, block, name, score) for score, name in tree.search(v, k, ids, own, least)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "block", "vec_id", "score"), cols, strict=True)})

    return work


def _searched(pairs: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """Results of the (query, block) pairs; a block's queries are dealt into parts of ``QUERIES``."""
    pairs = cut(pairs, "pairs")
    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))  # a row a block, as many as roots
    parts = F.broadcast(parts)
    left = pairs.join(parts, "block").select("row", "id", "raw", "least", "block", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("q"))
    right = trees.select("block", "ids", "tree").join(parts, "block").select("block", "ids", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    return left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInArrow(_look(k), "row long, block long, vec_id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the k other rows of the highest integer inner product.

    Components x become ``floor(scale * x)``. Rows where ``is_query`` (over
    ``id_col``) holds are the queries; all rows are candidates. Different
    vectors are dealt to cells by centres fitted on a sample, large cells to
    blocks, and each block gets an M-tree. A query first searches the block
    whose root is nearest; its k-th score then decides which roots' covering
    radii leave room for more, and only those blocks are searched. Nothing is
    approximate: bounds allow for rounding, scores are whole numbers.

    Defined cases: ids are whole numbers; vectors that are null or hold null or non-finite components, and
    rows without id, take no part; vectors of different length are not
    compared; equal scores go by smaller id; rows that share id and vector are
    one; a query's own id is no candidate; zero and empty vectors score 0;
    of equal vectors a tree holds one with its k + 1 smallest ids, which is all that can be
    asked for; fewer than k candidates give fewer rows, an empty table none;
    scores that could leave 64 bits raise an ArithmeticError; other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    read = cut(own.mapInArrow(_whole(scale), "id long, dim int, raw binary, squared long"), "vectors")
    sizes = {r["dim"]: (r["n"], r["longest"]) for r in read.groupBy("dim").agg(F.count("*").alias("n"), F.max("squared").alias("longest")).collect()}  # a row a vector length
    longest = {dim: top for dim, (_, top) in sizes.items()}
    smallest = read.withColumn("nth", F.dense_rank().over(Window.partitionBy("dim", "raw").orderBy("id"))).where(F.col("nth") <= k + 1)
    part = cut(smallest.groupBy("dim", "raw").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("squared").alias("squared")), "distinct")

    draw, share = F.pmod(F.xxhash64(F.lit("cells"), "raw"), F.lit(1_000_003)) / 1_000_003, F.lit(0.0)
    many = {dim: n for dim, (n, _) in sizes.items() if n >= 2 * BLOCK}  # else one cell
    for dim, n in many.items():
        share = F.when(F.col("dim") == dim, F.lit(max(SAMPLE, SAMPLE_PER_CELL * cells_for(n)) / n)).otherwise(share)
    drawn = part.where(draw < share).select("dim", "raw").toArrow() if many else None
    centres = {}
    for dim, n in many.items():
        x = _matrix(drawn.filter(pa.compute.equal(drawn["dim"], dim))["raw"], dim)
        if len(x) >= 2 * SAMPLE_PER_CELL:
            centres[dim] = fit_cells(_filled(x, longest[dim]), min(cells_for(n), len(x) // SAMPLE_PER_CELL))
    placed = cut(part.mapInArrow(_assign(spark.sparkContext.broadcast(centres), longest), "dim int, raw binary, ids array<long>, squared long, cell long"), "placed")
    most = 2 * max(BLOCK, int(np.sqrt(max((n for n, _ in sizes.values()), default=0))))
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    # a row a cell, of which there are as many as centres
    dealt = placed.join(F.broadcast(cells), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("raw"), "parts").cast("int"))
    trees = dealt.select("dim", "cell", "part", "raw", "ids").groupBy("dim", "cell", "part").applyInArrow(_grow(longest), "dim int, cell long, part int, centre binary, radius double, ids array<array<long>>, tree binary")
    trees = cut(trees.withColumn("block", F.monotonically_increasing_id()), "trees")
    roots: dict[int, tuple] = {}
    tops = trees.select("dim", "block", "centre", "radius").toArrow()  # a row a block, as many as centres
    for dim in longest:
        got = tops.filter(pa.compute.equal(tops["dim"], dim))
        if got.num_rows:
            roots[dim] = got["block"].to_numpy(), _matrix(got["centre"], dim).astype(np.float64), got["radius"].to_numpy()
    sent = spark.sparkContext.broadcast(roots)

    named = F.col("id").alias(id_col)
    asked = read.select(named, "dim", "raw", "squared").where(is_query).select(F.col(f"`{id_col}`").alias("id"), "dim", "raw", "squared").distinct()
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    fields = "row long, id long, dim int, raw binary, squared long, least long, block long"
    home = cut(asked.withColumn("least", F.lit(None).cast("long")).mapInArrow(_route(sent, longest, True), fields), "home")
    first = cut(_searched(home, trees, k), "first")
    reached = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    again = home.drop("least").join(reached, "row", "left").withColumnRenamed("reached", "least").select("row", "id", "dim", "raw", "squared", "least", "block")
    more = _searched(again.mapInArrow(_route(sent, longest, False), fields), trees, k)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
