"""Integer k-means whose assignment skips centroids by n-simplex projection.

A few pivots are taken from the first centroids.  A point's exact squared distances to them
place it as the apex of a simplex over the pivots: coordinates inside the pivots' own
subspace and a height above it.  Two points whose apexes are known are at least as far apart
as the apexes with both heights on one side, and at most as far as with the heights on opposite
sides.  The apexes of the vectors are computed once and written; each round places the
centroids in the same space, drops every centroid whose lower bound is above the smallest
upper bound of the vector, and decides among the others by exact integer distances.

A round is one scan: every task sums its vectors by cluster, Spark adds the sums up, and only
the sums of the (at most ``k``) clusters reach the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import written

DIM, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Pivots of the projection, and the least share of a pivot's distance that must stand above the others.
PIVOTS, FLATTEST = 24, 0.05
#: Largest integer component: the squared distance of two such vectors still fits a long.
LARGEST = 1 << 27
_ROWS = 4096
_NONE = np.iinfo(np.int64).max


class Simplex:
    """Apex coordinates over pivots that are affinely independent (others are left out)."""

    def __init__(self, candidates: np.ndarray, pivots: int = PIVOTS):
        self.base = candidates[0].copy()
        chosen, rows = [], []
        far = squared_distances(candidates, candidates[:1])[:, 0].astype(float)
        left = list(np.argsort(-far, kind="stable"))
        for c in left:
            if len(chosen) == pivots - 1 or far[c] <= 0:
                break
            place = self._inside(candidates[c:c + 1], np.array(chosen, dtype=np.int64).reshape(-1, candidates.shape[1]), rows)[0]
            height2 = far[c] - place @ place
            if height2 >= FLATTEST * far[c]:
                chosen.append(candidates[c])
                rows.append(np.append(place, np.sqrt(height2)))
        self.pivots = np.array(chosen, dtype=np.int64).reshape(-1, candidates.shape[1])
        self.rows = rows

    def _inside(self, x: np.ndarray, pivots: np.ndarray, rows: list) -> np.ndarray:
        """Coordinates in the pivots' subspace, by forward substitution from cached distances."""
        out = np.zeros((len(x), len(rows)))
        if not rows:
            return out
        from_base = squared_distances(x, self.base[None])[:, 0].astype(float)
        to_pivots = squared_distances(x, pivots).astype(float)
        for i, row in enumerate(rows):
            dot = (from_base + row @ row - to_pivots[:, i]) / 2  # product of x and pivot i, both seen from the base
            out[:, i] = (dot - out[:, :i] @ row[:i]) / row[i]
        return out

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """(rows x (pivots - 1 + 1)): coordinates and, last, the height."""
        inside = self._inside(x, self.pivots, self.rows)
        above = squared_distances(x, self.base[None])[:, 0].astype(float) - (inside * inside).sum(axis=1)
        return np.hstack([inside, np.sqrt(np.maximum(above, 0))[:, None]])


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows (rows of x by rows of c)."""
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the squared distances of points with apexes ``a`` and ``b``,
    widened by an allowance for rounding."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    ha, hb = a[:, -1:], b[None, :, -1]
    slack = 1e-7 * ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]) + 1e-6
    return flat + (ha - hb) ** 2 - slack, flat + (ha + hb) ** 2 + slack


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, places: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, number of exact comparisons) of every row; ties go to the
    smaller number."""
    cluster, distance, tried = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), 0
    for s in range(0, len(x), _ROWS):
        e = min(s + _ROWS, len(x))
        lower, upper = bounds(apexes[s:e], places)
        i, j = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        d = x[s + i] - centroids[j]
        exact = np.full((e - s, len(centroids)), _NONE, np.int64)
        exact[i, j] = np.einsum("ij,ij->i", d, d)
        cluster[s:e] = exact.argmin(axis=1)
        distance[s:e] = exact.min(axis=1)
        tried += len(i)
    return cluster, distance, tried


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=dtype).reshape(len(column), -1)


def _sums(points: DataFrame, simplex: Simplex, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """{cluster: (members, componentwise sum)} of the non-empty clusters."""
    known = points.sparkSession.sparkContext.broadcast((centroids, simplex.apexes(centroids)))
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, places = known.value
        total = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), np.int64)
                cluster, _, _ = nearest(x, _matrix(b.column(1), np.float64), centres, places)
                order = np.argsort(cluster, kind="stable")
                some, first = np.unique(cluster[order], return_index=True)
                total[some, :dim] += np.add.reduceat(x[order], first, axis=0)
                total[some, dim] += np.bincount(cluster, minlength=k)[some]
        c, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(c.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["c", "j", "s"])

    sums = points.select("x", "apex").mapInArrow(run, "c long, j long, s long").where("s <> 0")
    sums = sums.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))  # k * (dim + 1) rows at most
    out = np.zeros((k, dim + 1), dtype=object)
    for r in sums.collect():
        out[r["c"], r["j"]] = int(r["s"])
    return {c: (out[c, dim], out[c, :dim]) for c in range(k) if out[c, dim]}


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM,
                    centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
                    pivots: int = PIVOTS) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per kept row.

    Kept are vectors with exactly ``dim`` components, none null or non-finite; x becomes
    floor(scale * x).  The first centroids are the rows with the smallest sha256 of
    "2:<id>" (equal ids: by the vector; null ids last), as many as there are if fewer.
    Repeated rows are rows of their own; an empty table gives an empty result; extra columns
    are ignored.  Rows with an integer beyond 2**27, whose distances need not fit a long, take
    no part and come back with nulls; so does a sum of distances beyond a long."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce((F.size("v") == dim) & finite, F.lit(False)))
    large = F.exists("v", lambda x: F.abs(F.floor(x * scale).cast("double")) > float(LARGEST)) \
        | F.exists("v", lambda x: F.abs(x) > float(LARGEST))
    whole = rows.where(~large).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("x"))
    rank = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    first = whole.select("x", rank.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(centroids).collect()
    shape = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in shape.split(", ")]
    beyond = rows.where(large).select(F.col("id").alias(id_col), *none)
    if not first:
        return beyond
    centres = np.array([r["x"] for r in first], dtype=np.int64)
    simplex = Simplex(centres, pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(simplex)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = shared.value.apexes(_matrix(b.column(1), np.int64))
                apex = pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([b.column(0), b.column(1), apex], ["id", "x", "apex"])

    points = written(whole.mapInArrow(place, f"id {id_type}, x array<int>, apex array<double>"), "apexes")
    for _ in range(rounds):
        for c, (n, s) in _sums(points, simplex, centres).items():
            centres[c] = [int(v) // int(n) for v in s]
    known = vectors.sparkSession.sparkContext.broadcast((centres, simplex.apexes(centres)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c, d, _ = nearest(_matrix(b.column(1), np.int64), _matrix(b.column(2), np.float64), *known.value)
                yield pa.record_batch([b.column(0), pa.array(c), pa.array(d)], ["id", "cluster", "distance"])

    assigned = written(points.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), "assigned")
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    fits = lambda v: int(v) if int(v) <= _NONE else None
    total = fits(sum(r["s"] for r in per))
    facts = [(r["cluster"], fits(r["s"]), total,
              hashlib.sha256(",".join(map(str, centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in per]
    facts = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(facts), "cluster").select(  # at most k rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out.unionAll(beyond)
