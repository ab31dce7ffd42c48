"""Exact cosine links and components of embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to the principal axes of the whole table, so the
leading dimensions hold most of each length.  Tiles of vectors are compared two at a time:
a matrix product over the leading dimensions gives partial cosines, and by Cauchy-Schwarz
the rest of a cosine is at most the product of the two suffix norms.  Pairs whose partial
sum plus that bound cannot reach the threshold are given up after each group of
dimensions; the few that remain are decided by the full cosine of the original vectors in
double precision.

Equal vectors are one class and compared once.  Tiles are written once, a row each, and every
task of a cartesian product reads two of them from the checkpoint folder, so no vector is shuffled
once per tile and the disk grows with the rows.  No pair leaves a task: a tile comparison
returns per class a number of links (weighted by class sizes) and, for the components, a
spanning forest of its links.  Every tile knows the components of its own links, so two tiles
add an edge only where they join such components: a dense group costs an edge a member and one
more a pair of tiles."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import written
from annualis.llm.components import connected_components
from annualis.session import cut_lineage, parallelism

THRESHOLD = 0.9
#: Bytes of the vectors of one tile as doubles; a task holds two.
TILE_BYTES = 16 << 20
#: Most parts of the tiles: their square is the number of tasks; a part holds several tiles if need be.
#: Parts for the sake of the cores only have this many rows or more.
MOST_PARTS, PART_ROWS = 256, 8192
STEP = 16
#: Rows and columns compared at once, and pairs measured at once.
_ROWS, _COLS, _PAIRS = 256, 1024, 1 << 15


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(dim x dim) rotation to the axes of the second moments of all unit vectors, largest
    first, and the moments along them (their sum is 1): every task sums its outer products,
    Spark adds these up by matrix row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _units(_vectors(b.column(0), dim))
                total += u.T @ u
        i, j = np.indices((dim, dim))
        yield pa.record_batch([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    rows = vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((dim, dim))
    for r in rows:
        m[r["i"], r["j"]] = r["s"]
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return axes[:, ::-1].copy(), values[::-1] / values.sum()


def leading(moments: np.ndarray, threshold: float) -> int:
    """Dimensions of the first bound: as few as leave about one unrelated pair in thousands."""
    for m in range(8, len(moments), 8):
        if threshold - moments[m:].sum() >= 3.5 * np.sqrt((moments[:m] ** 2).sum()):
            return m
    return len(moments)


def _slack(dim: int) -> float:
    """Rounding allowance of partial sums and norms in single precision."""
    return 1e-5 + 1e-7 * dim


class Rotated(NamedTuple):
    """Unit rows; in single precision their rotation, the suffix norms at the group ends and, for
    the first bound, the leading dimensions with the norm of the rest as one more."""

    unit: np.ndarray
    turned: np.ndarray
    cuts: list[int]
    tails: np.ndarray
    first: np.ndarray


def rotated(unit: np.ndarray, axes: np.ndarray, lead: int, step: int = STEP) -> Rotated:
    dim = unit.shape[1]
    cuts = [*range(lead, dim, step), dim]
    r = (unit @ axes).astype(np.float32)
    tails = np.column_stack([np.sqrt(np.einsum("ij,ij->i", r[:, c:], r[:, c:])) for c in cuts])
    return Rotated(unit, r, cuts, tails, np.column_stack([r[:, :lead], tails[:, 0]]))


def _true(bits: np.ndarray) -> np.ndarray:
    """Places of the true values of a flat array, looked for eight at a time."""
    if len(bits) % 8:
        return np.flatnonzero(bits)
    some = np.flatnonzero(bits.view(np.uint64))
    w, k = np.nonzero(bits.reshape(-1, 8)[some])
    return some[w] * 8 + k


def _measured(a: Rotated, b: Rotated, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) with cosine >= threshold: given up group by group, the rest measured."""
    got, least = np.float32(0), threshold - _slack(a.cuts[-1])
    for k, (lo, hi) in enumerate(zip([0, *a.cuts], a.cuts, strict=False)):
        got = got + np.einsum("ij,ij->i", a.turned[i, lo:hi], b.turned[j, lo:hi])
        if hi < a.cuts[-1]:
            live = got + a.tails[i, k] * b.tails[j, k] >= least
            i, j, got = i[live], j[live], got[live]
    exact = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold
    return i[exact], j[exact]


def close_pairs(a: Rotated, b: Rotated, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (row of a, row of b) with cosine >= threshold; of ``a`` and itself every pair
    i < j once."""
    held, size = [], 0
    least = np.float32(threshold - _slack(a.cuts[-1]))
    for s in range(0, len(a.unit), _ROWS):
        part = a.first[s:s + _ROWS]
        for c in range(s // _COLS * _COLS if a is b else 0, len(b.unit), _COLS):
            bound = part @ b.first[c:c + _COLS].T
            at = _true((bound >= least).ravel())
            i, j = at // bound.shape[1] + s, at % bound.shape[1] + c
            if a is b:
                i, j = i[i < j], j[i < j]
            held.append((i, j))
            size += len(i)
            if size >= _PAIRS:
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                for k in range(0, size, _PAIRS):
                    yield _measured(a, b, i[k:k + _PAIRS], j[k:k + _PAIRS], threshold)
                held, size = [], 0
    if size:
        yield _measured(a, b, *(np.concatenate(x) for x in zip(*held, strict=True)), threshold)


def _forest(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
    """(weighted link counts, spanning edges) of the pairs over nodes that are joined to ``root``
    already; ``root`` is brought up to date."""
    links = np.zeros(len(root), np.int64)
    edges = []
    for i, j in pairs:
        np.add.at(links, i, weights[j])
        np.add.at(links, j, weights[i])
        while len(i):
            p, q = root[i], root[j]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            high, low = np.maximum(p, q), np.minimum(p, q)
            high, first = np.unique(high, return_index=True)  # one edge joins a root to a lower one
            root[high] = low[first]
            edges.extend(zip(i[first].tolist(), j[first].tolist(), strict=True))
            while (root[root] != root).any():
                root[:] = root[root]
    return links, edges


def tiled(classes: DataFrame, n: int, dim: int, tile_bytes: int, axes: np.ndarray, lead: int, threshold: float) -> DataFrame:
    """(tile, ids, n, root, v): the ``n`` classes of one length in tiles, each one row of packed
    numbers with the components of its own links, checkpointed so that a part is read without
    the others."""
    most = max(1, tile_bytes // (8 * dim))
    wide = dict(classes.dtypes)["v"] == "array<double>"
    known = classes.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, count, v = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy()
            own, root = rotated(_units(v.reshape(-1, dim).astype(np.float64)), known.value, lead), np.arange(len(ids))
            _forest(root, close_pairs(own, own, threshold), count)
            return pa.record_batch([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in
                                    ((ids, "<i8"), (count, "<i8"), (root, "<i4"), (v, "<f8" if wide else "<f4"))],
                                   ["ids", "n", "root", "v"])

        held, size = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - size))
                b = b.slice(most - size)
                size += held[-1].num_rows
                if size == most:
                    yield tile()
                    held, size = [], 0
        if held:
            yield tile()

    busy = min(2 * int(np.ceil(np.sqrt(parallelism(classes.sparkSession)))), -(-n // PART_ROWS))
    parts = min(MOST_PARTS, max(-(-n // most), busy))
    packed = classes.select("id", "n", "v").coalesce(parts).mapInArrow(run, "ids binary, n binary, root binary, v binary")
    return cut_lineage(packed.select(F.monotonically_increasing_id().alias("tile"), "*"))


def _compared(tiles: DataFrame, axes: np.ndarray, lead: int, wide: bool, threshold: float) -> DataFrame:
    """(id, other, links) of every tile pair: a row with a null ``other`` carries a link
    count, one with a null count a spanning edge.  Two tiles meet twice in the product: each
    time half of the rows of the lower one are compared."""
    dim = len(axes)
    known = tiles.sparkSession.sparkContext.broadcast(axes)

    def read(b: pa.RecordBatch, side: str, row: int, half: int | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rotated]:
        ids, n, root, v = (np.frombuffer(b.column(f"{c}_{side}")[row].as_buffer(), k)
                           for c, k in (("ids", "<i8"), ("n", "<i8"), ("root", "<i4"), ("v", "<f8" if wide else "<f4")))
        cut = (slice(None) if half is None else slice(len(ids) // 2) if half == 0 else slice(len(ids) // 2, None))
        _, first, which = np.unique(root[cut], return_index=True, return_inverse=True)
        return ids[cut], n[cut], first[which], rotated(_units(v.reshape(-1, dim)[cut].astype(np.float64)), known.value, lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                left, right = b.column("tile_l")[row].as_py(), b.column("tile_r")[row].as_py()
                if left == right:
                    ids, n, _, low = read(b, "l", row)
                    root, pairs = np.arange(len(ids)), close_pairs(low, low, threshold)
                else:
                    ids, n, root, low = read(b, "l", row, 0) if left < right else read(b, "r", row, 1)
                    more, m, other, high = read(b, "r" if left < right else "l", row)
                    pairs = ((i, j + len(low.unit)) for i, j in close_pairs(low, high, threshold))
                    ids, n, root = np.concatenate([ids, more]), np.concatenate([n, m]), np.concatenate([root, other + len(ids)])
                links, edges = _forest(root, pairs, n)
                some = np.flatnonzero(links)
                x, y = (ids[np.array(e, np.int64)] for e in (zip(*edges, strict=True) if edges else ((), ())))
                yield pa.record_batch([
                    pa.array(np.concatenate([ids[some], x])),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(y, pa.int64())]),
                    pa.concat_arrays([pa.array(links[some]), pa.nulls(len(x), pa.int64())])], ["id", "other", "links"])

    left, right = (tiles.select([F.col(c).alias(f"{c}_{side}") for c in tiles.columns]) for side in "lr")
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, "id long, other long, links long")


def _keys(v: str) -> dict[str, Column]:
    """128 bits that stand for a vector where rows look up their class."""
    return {f"key{k}": F.xxhash64(F.lit(k), v) for k in range(2)}


def cosine_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                      threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row per input row with a non-null id.

    n_links counts the other rows with cosine >= threshold (0 < threshold), component_id is
    the smallest id reachable by links, kept is ``id = component_id``.  Null, empty and zero
    vectors and those with null or non-finite components link with nothing; vectors of
    different lengths do not link; repeated rows are rows of their own that link with each
    other; extra columns are ignored."""
    given = vectors.schema[vector_col].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"  # single precision loses nothing and is half the bytes
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    classes = rows.where(usable).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumns(_keys("v")), "vectors")
    found, total = [], 0
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        dim, total = r["dim"], total + r["n"]
        same = classes.where(F.size("v") == dim)
        axes, moments = principal_axes(same, dim)
        lead = leading(moments, threshold)
        tiles = tiled(same, r["n"], dim, tile_bytes, axes, lead, threshold)
        found.append(_compared(tiles, axes, lead, kind == "array<double>", threshold))
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    result = written(result, "tiles")
    links = result.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(result.where("other is not null"), "id", "other")
    on = list(_keys("v"))
    if classes.select(on).distinct().count() < total:
        on = ["v"]  # two vectors share their keys: rows look up the vector itself
    placed = (classes.join(links, "id", "left").join(parts, "id", "left")
              .select(*on, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                      F.coalesce("component", "id").alias("component")))
    if on != ["v"]:
        rows = rows.select("id", *[F.when(usable, x).alias(c) for c, x in _keys("v").items()])
    joined = rows.join(placed, on, "left")
    out = joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                        F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
