"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodiff.llm.tables import components, cut, small_batches

#: Vectors that the centroids are fitted on, about: so many, and so many a cell.
SAMPLE, SAMPLE_PER_CELL = 20_000, 8
#: Vectors of a cell, on average, until there are as many cells; from then on cells and their vectors grow alike.
CELL = 4096
#: Vectors on either side of one blocked product.
BLOCK = 4096
#: Rows of a product held at once, and vectors that are held against all centroids at once.
STRIP = 512
#: How far below the threshold a single-precision product may be and still be computed in double precision.
MARGIN = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; rows that are zero or not finite stay zero."""
    x = x.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[~np.isfinite(x).all(axis=1)] = 0.0
    return x


def _usable(dtype: str):
    """(id, vector) to (id, dim, raw bytes); null raw where nothing can be linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            offsets = vecs.offsets.to_numpy()
            inner = vecs.values.slice(offsets[0], offsets[-1] - offsets[0])
            flat = inner.to_numpy(zero_copy_only=False).astype(dtype)  # nulls become NaN
            offsets = (offsets - offsets[0]).astype(np.int64)
            dims = np.diff(offsets)
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            fine = np.array(vecs.is_valid()) & (dims > 0) & (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
            data, size = flat.tobytes(), flat.itemsize
            raw = [data[a * size : b * size] if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), fine.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "dim", "raw"])

    return work


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def fit_cells(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length 1 by spherical k-means; at most ``k``, all different."""
    x = _unit(sample).astype(np.float32)
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centres)
    return np.unique(centres.astype(np.float64), axis=0)


def cells_for(n: int) -> int:
    """Cells for n vectors: of ``CELL`` vectors each, and the root of n of them beyond ``CELL ** 2`` vectors.

    A vector is then held against root-n centroids and root-n others of a cell.
    """
    return max(1, min(n // CELL, int(np.sqrt(n))) if n > CELL * CELL else n // CELL)


def _assign(centres: dict[int, np.ndarray], cosine: float, dtype: str):
    """For each vector the cell it is nearest to, and the lower cells in which a vector may link to it.

    A vector x of cell a lies on a's side of the plane between the centres of a
    and b; a vector y of cell b that links to x lies within the link's angle of
    that plane. So y visits a if sin(angle) reaches its distance to the plane.
    Lower cells are enough: each pair of cells then meets once.
    """
    reach = float(np.sqrt(max(0.0, 1 - cosine * cosine))) + 1e-9 if cosine >= 0 else 2.0

    def placed(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        home, cells = np.empty(len(x), np.int32), []
        strip = max(1, min(STRIP, (1 << 22) // len(c)))
        for lo in range(0, len(x), strip):
            near = x[lo : lo + strip] @ c.T
            own = near.argmax(axis=1)
            home[lo : lo + strip] = own
            apart = np.sqrt(np.maximum(2 - 2 * (c[own] @ c.T), 1e-30))  # both of length 1
            far = (near[np.arange(len(own)), own][:, None] - near) / apart
            visit = (far <= reach + 1e-6) & (np.arange(len(c))[None, :] < own[:, None])
            cells += [np.flatnonzero(r).tolist() for r in visit]
        return home, cells

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                home, cells = placed(_unit(_matrix(own.column(2), dtype)), shared(dim))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(home), pa.array(cells, pa.list_(pa.int32()))], ["id", "dim", "home", "visits"])

    def shared(dim: int) -> np.ndarray:
        got = centres.value if hasattr(centres, "value") else centres
        return got.get(dim, np.eye(1, dim))

    return work


def _linked(left: np.ndarray, right: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Which pairs reach the cosine in double precision; with ``same``, both sides are one block."""
    a, b = left.astype(np.float32), right.astype(np.float32)
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), STRIP):
        close = a[lo : lo + STRIP] @ b.T >= cosine - MARGIN
        i, j = np.nonzero(close)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)]
            out[p, q] = np.einsum("ij,ij->i", left[p], right[q]) >= cosine
    if same:
        np.fill_diagonal(out, False)
    return out


def _trees(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, smallest row found) of the connected rows; columns follow the rows unless both sides are one block."""
    n, m = links.shape
    seen_l, seen_r = np.zeros(n, bool), np.zeros(m, bool)
    out = []
    for start in np.flatnonzero(links.any(axis=1)).tolist():
        if seen_l[start]:
            continue
        front = np.array([start])
        seen_l[start] = True
        while len(front):
            right = links[front].any(axis=0) & ~seen_r
            seen_r |= right
            if same:
                front = np.flatnonzero(right & ~seen_l)
                seen_l[front] = True
                out += [(start, k) for k in front.tolist()]
            else:
                found = np.flatnonzero(right)
                out += [(start, n + k) for k in found.tolist()]
                front = np.flatnonzero(links[:, found].any(axis=1) & ~seen_l) if len(found) else found
                seen_l[front] = True
                out += [(start, k) for k in front.tolist()]
    return out


def _product(cosine: float, dtype: str):
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies, right = table["id"].to_numpy(), table["copies"].to_numpy(), table["right"].to_numpy(zero_copy_only=False)
        x = _unit(_matrix(table["raw"], dtype))
        l, r = np.flatnonzero(~right), np.flatnonzero(right)
        same = not len(r)
        r = l if same else r
        links = _linked(x[l], x[r], cosine, same)
        counts = np.zeros(len(ids), np.int64)
        counts[l] = links @ copies[r]
        if not same:
            counts[r] = links.T @ copies[l]
        names = np.concatenate([ids[l], ids[r]])
        edges = np.array(_trees(links, same), np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        a = np.concatenate([ids[some], names[edges[:, 0]]])
        b = np.concatenate([ids[some], names[edges[:, 1]]])
        n = np.concatenate([counts[some], np.zeros(len(edges), np.int64)])
        return pa.table({"a": pa.array(a, table["id"].type), "b": pa.array(b, table["id"].type), "n": n})

    return work


def _blocks(vectors: DataFrame, placed: DataFrame) -> DataFrame:
    """Every vector with each product that it takes part in: ``dim``, ``cell``, ``i``, ``j``, ``right``."""
    home = placed.select("id", "dim", F.col("home").alias("cell"))
    away = placed.select("id", "dim", F.explode("visits").alias("cell"))
    n_home = home.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    n_away = away.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q"))
    sizes = n_home.join(n_away, ["dim", "cell"], "left").select("dim", "cell", "m", F.coalesce("q", F.lit(0)).alias("q"))
    # a row a cell, of which there are as many as centroids, which the driver holds
    sizes = F.broadcast(cut(sizes, "cells"))
    home = home.join(sizes, ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), "m").cast("int"))
    away = away.join(sizes, ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), "q").cast("int"))
    base, with_home = ["id", "dim", "cell"], F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")
    within = home.select(*base, "own", with_home).select(*base, F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).alias("right"))
    across = home.where("q > 0").select(*base, F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("f"), F.lit(False).alias("right"))
    across = across.unionByName(away.select(*base, with_home.alias("i"), F.col("own").alias("f"), F.lit(True).alias("right")))
    # products with visitors have negative numbers, so that they are no pair of home blocks
    across = across.select(*base, "i", (-1 - F.col("f")).alias("j"), "right")
    return within.unionByName(across).join(vectors, ["id", "dim"])


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``id``, ``n_links`` and ``component`` of every row.

    Two vectors are linked if their cosine, in double precision, is at least
    ``cosine``; a component is named by the smallest id that links reach.
    Equal vectors are one vector with a number of copies. Centroids are fitted
    on about ``SAMPLE`` vectors, or ``SAMPLE_PER_CELL`` a cell; then every vector is compared with all of its
    cell and with all of the other cells' vectors that can link to it (see
    ``_assign``), in blocks of ``BLOCK``, so no link is lost at any cell border
    and no task grows with the cell. A product returns counts and a spanning
    tree of its links, never its pairs.

    Defined cases: vectors that are null, empty, zero, or hold null or
    non-finite components are linked with nothing; vectors of different length
    are not compared; a row without id is linked with nothing and its component
    is null; rows that share id and vector are one; a pair exactly at ``cosine``
    is linked, and a vector as near to two centroids belongs to the first; other
    columns, whatever their names, are not read; an empty table stays empty.
    """
    small_batches(rows.sparkSession)
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"))
    kind = own.schema["id"].dataType.simpleString()
    dtype = "<f4" if own.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"
    own = own.withColumn("vec", F.col("vec").cast("array<float>" if dtype == "<f4" else "array<double>"))
    read = cut(own.mapInArrow(_usable(dtype), f"id {kind}, dim int, raw binary"), "vectors")
    used = read.where("raw is not null and id is not null").select("id", "dim", "raw", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(1), "raw").alias("h2"))
    same = cut(used.groupBy("dim", "h1", "h2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"), F.min_by("raw", "id").alias("raw")), "vectors")
    part = same.select(F.col("rep").alias("id"), "dim", "copies", "raw")
    sizes = {r["dim"]: r["count"] for r in same.groupBy("dim").count().collect()}  # a row a vector length
    draw = F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1_000_003)) / 1_000_003
    share = F.lit(0.0)
    for dim, n in sizes.items():
        if n >= 2 * CELL:  # else one cell
            share = F.when(F.col("dim") == dim, F.lit(max(SAMPLE, SAMPLE_PER_CELL * cells_for(n)) / n)).otherwise(share)
    drawn = part.where(draw < share).select("dim", "raw").toArrow() if max(sizes.values(), default=0) >= 2 * CELL else None
    centres = {}
    for dim, n in sizes.items():
        own = _matrix(drawn.filter(pa.compute.equal(drawn["dim"], dim))["raw"], dtype) if drawn is not None and n >= 2 * CELL else np.zeros((0, dim))
        if len(own):
            centres[dim] = fit_cells(own, max(1, min(cells_for(n), len(own) // SAMPLE_PER_CELL)))
    placed = cut(part.select("id", "dim", "raw").mapInArrow(_assign(spark.sparkContext.broadcast(centres), cosine, dtype), f"id {kind}, dim int, home int, visits array<int>"), "cells")
    found = cut(_blocks(part, placed).groupBy("dim", "cell", "i", "j").applyInArrow(_product(cosine, dtype), f"a {kind}, b {kind}, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    named = same.select("rep", "dim", "h1", "h2", "copies").join(counts, "rep", "left").join(comps, "rep", "left")
    named = named.select("dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = used.select("id", "dim", "h1", "h2").join(named, ["dim", "h1", "h2"]).select("id", "n_links", "component")
    rest = read.where("raw is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(rest)
