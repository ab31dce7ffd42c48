"""Whitening of embeddings with eigenvectors found by spectrum slicing.

One scan sums the integer vectors and their products exactly, so the covariance is centred in
integers ((n * products - sums * sums) / n^2 equals the mean of centred products, without
cancellation).  Its leading eigenpairs come from inertia counts: the symmetric factorisation
L D L^T of the covariance minus a shift has as many positive pivots as there are
eigenvalues above the shift, so bisection on the shift isolates the k-th eigenvalue.  Inverse
iteration inside the interval and then Rayleigh quotient iteration, which converges
cubically, give the pair; two counts just below and above the result certify its number.

The matrix has one row per dimension of the vectors, whatever the number of rows; a second scan
projects every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Vectors with floor(64 * c) beyond this in any entry are left out, like non-finite ones.
LARGEST = 1 << 31
#: Eigenvalues closer than this share of the trace count as one, of several dimensions; below
#: the same share an eigenvalue counts as zero.
CLOSE = 1e-12
_GROWTH = (1 + 17 ** 0.5) / 8


def pivots_above(m: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``m`` above ``shift``: the positive part of the
    inertia of D in the factorisation L D L^T of m - shift, with pivots of size one and two."""
    a = m - shift * np.eye(len(m))
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        q, r = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= _GROWTH * off[q, r]:
            if diagonal[p] == 0:
                return above  # the rest is zero: eigenvalues equal to the shift
            above += a[p, p] > 0
            rest = np.delete(np.arange(len(a)), p)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[p, rest]) / a[p, p]
        else:
            pair, rest = [q, r], np.delete(np.arange(len(a)), [q, r])
            block = a[np.ix_(pair, pair)]
            above += 1  # its determinant is negative: one eigenvalue on each side
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(block, a[np.ix_(pair, rest)])
        a = (a + a.T) / 2
    return above


def _solve(m: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    """(m - shift)^-1 v of length one; a singular shift is moved by a rounding error."""
    for step in (0.0, 1e-15, -1e-15, 1e-14):
        try:
            w = np.linalg.solve(m - (shift + step * scale) * np.eye(len(m)), v)
        except np.linalg.LinAlgError:
            continue
        size = np.sqrt(w @ w)
        if np.isfinite(size) and size > 0:
            return w / size
    return v


def _apart(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.sqrt(v @ v)


def leading_pairs(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of the ``most`` largest positive
    eigenvalues of a positive semi-definite matrix; zero ones are left out."""
    trace = float(np.trace(m))
    if not len(m) or trace <= 0:
        return np.zeros(0), np.zeros((0, len(m)))
    tiny = CLOSE * trace
    counts: dict[float, int] = {}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = pivots_above(m, x)
        return counts[x]

    counts[trace * (1 + 1e-9)] = 0  # no eigenvalue of a semi-definite matrix is above its trace
    values, vectors = [], []
    rng = np.random.default_rng(len(m))
    while len(values) < min(most, above(tiny)):
        k = len(values)
        low = max(x for x, c in counts.items() if c > k)
        high = min(x for x, c in counts.items() if c <= k)
        while above(low) - above(high) > 1 and high - low > tiny:
            mid = (low + high) / 2
            low, high = (mid, high) if above(mid) > k else (low, mid)
        together = above(low) - above(high) > 1  # equal to rounding: any basis of their space will do
        v = _apart(rng.standard_normal(len(m)), vectors)
        while True:
            w = v
            for _ in range(4):
                w = _apart(_solve(m, (low + high) / 2, w, trace), vectors)
            e = w @ m @ w
            for _ in range(12):  # Rayleigh quotient iteration, inside the interval only
                if together or not low < e < high:
                    break
                nxt = _apart(_solve(m, e, w, trace), vectors)
                settled = abs(nxt @ m @ nxt - e) <= 1e-15 * trace
                w, e = nxt, nxt @ m @ nxt
                if settled:
                    break
            wrong = np.abs(m @ w - e * w).max()
            if together or (low < e <= high and wrong <= CLOSE * trace):
                break
            if high - low <= tiny / 64:
                break
            mid = (low + high) / 2  # it left the interval: isolate the eigenvalue more closely
            low, high = (mid, high) if above(mid) > k else (low, mid)
        if not together and not above(e - 2 * tiny) > k >= above(e + 2 * tiny):
            raise ArithmeticError(f"eigenvalue {k + 1} is not certified by its inertia counts")
        values.append(float(e))
        vectors.append(w)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(values), len(m))[order]


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dim)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x^T x as Python integers: in doubles where all sums stay below 2^53."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:
        f = x.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.T @ o


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, product sums) of the integer vectors ``y``, exact; tasks sum their rows, Spark
    adds up one matrix row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            if b.num_rows:
                y = _integers(b.column(0), dim)
                n, s, q = n + len(y), s + y.astype(object).sum(axis=0), q + _products(y)
        if n:
            rows = [[str(n), str(s[i]), *map(str, q[i])] for i in range(dim)]
            yield pa.record_batch([pa.array(range(dim), pa.int64()), pa.array(rows)], ["i", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(dim + 2, object)
        for part in table.column("part"):
            total += np.array([int(x) for x in part.as_py()], dtype=object)
        return pa.table({"i": table.column("i")[:1], "part": pa.array([[str(x) for x in total]])})

    shape = "i long, part array<string>"
    rows = vectors.select("y").mapInArrow(run, shape).groupBy("i").applyInArrow(add, shape).collect()  # dim rows
    n, s, q = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
    for r in rows:
        part = [int(x) for x in r["part"]]
        n, s[r["i"]], q[r["i"]] = part[0], part[1], part[2:]
    return n, s, q


def covariance(n: int, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Centred second moments with divisor n, each entry rounded once."""
    dim, out = len(s), np.zeros((len(s), len(s)))
    for i in range(dim):
        for j in range(i, dim):
            out[i, j] = out[j, i] = (n * q[i, j] - s[i] * s[j]) / (n * n)
    return out


def _whitened(rows: DataFrame, dim: int, components: int, id_type: str) -> DataFrame:
    n, s, q = moments(rows, dim)
    v = covariance(n, s, q)
    e, axes = leading_pairs(v, components)
    scaled = axes / np.sqrt(e)[:, None]
    error = float(np.abs(scaled @ v @ scaled.T - np.eye(len(e))).max(initial=0))
    known = rows.sparkSession.sparkContext.broadcast((n, [int(x) for x in s], scaled, e / np.trace(v) if len(e) else e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, scaled, share = known.value
        k, top, squares = len(scaled), max(map(abs, s)), sum(x * x for x in s)
        floor = np.array([x // n for x in s], np.int64)
        rest = np.array([(x % n) / n for x in s])  # y - s / n = (y - floor) - rest, rounded once
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                y = _integers(part.column(1), dim)
                m = len(y)
                most = int(np.abs(y).max())
                if n * (most + top // n + 1) < 1 << 27:
                    d = n * y - np.array(s, np.int64)
                    deviation = pa.array((d * d).sum(axis=1))
                else:  # the same sum, multiplied out; Python integers where a long may not do
                    kind = np.int64 if dim * most * max(most, top) < 1 << 62 else object
                    z = y.astype(kind)
                    exact = n * n * (z * z).sum(axis=1).astype(object) - 2 * n * (z @ np.array(s, kind)).astype(object) + squares
                    deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
                d = (y - floor) - rest
                w = d @ scaled.T
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch([
                    part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)), deviation.take(row), pa.array(w.ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "y").mapInArrow(run, f"id {id_type}, component int, n long, deviation long, whitened double, "
                                                  "explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row per
    remaining vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are those with
    floor(scale * entry) beyond 2**31.  Vectors of different lengths are whitened apart, each
    length by its own fit.  Components with an eigenvalue of zero (constant dimensions, fewer
    vectors than components) have no rows; equal eigenvalues get any orthonormal basis.  Repeated rows
    and null ids are rows like others; an empty table gives an empty result; extra columns are
    ignored; a deviation beyond a long is null.  ``deviation`` does not depend on the constant
    added to the integers, so they are kept without it."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < float(LARGEST)))
    rows = rows.where(F.coalesce((F.size("v") > 0) & usable, F.lit(False)))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("y"))
    dims = rows.groupBy(F.size("y").alias("dim")).agg(F.count(F.lit(1))).orderBy("dim").collect()
    shape = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], shape)
    parts = [_whitened(rows.where(F.size("y") == d["dim"]), d["dim"], components, id_type) for d in dims]
    for i, part in enumerate(parts):
        part = part.withColumnRenamed("id", id_col)
        out = part if not i else out.unionAll(part)
    return out
