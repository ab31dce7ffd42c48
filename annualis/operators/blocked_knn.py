"""Exact nearest neighbours of a table of questions as blocked matrix products.

The vectors are scanned once per block of questions (one block up to ``BLOCK_BYTES`` of
question vectors); a task compares each Arrow batch with the block and keeps a running first k
per question, so at most k rows per question and task leave it.  Questions are grouped by which
of their filters are set: one without filters meets every row of a batch, one with
filters only the rows that hold its values, found by one sort of the batch per group of
questions (an equi-join inside the task: no row is repeated, none is compared in vain).

Products rank approximately and pass on every row within rounding of the k-th; those few are
measured exactly, component after component in double precision, so ties are real ties and break
by key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
#: Rows of a batch and questions of a block in one product.
_ROWS, _COLUMNS = 4096, 512


def exact_distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, summed in the order of the components."""
    def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            s += a[:, j] * b[:, j]
        return s

    with np.errstate(all="ignore"):
        if metric == "l2":
            return np.sqrt(total(x - q, x - q))
        return 1.0 - total(x, q) / (np.sqrt(total(x, x)) * np.sqrt(total(q, q)))


def _approximate(x: np.ndarray, q: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """(distances on a monotone scale, allowance for rounding) of all rows of x and q."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            nx, nq = (x * x).sum(axis=1), (q * q).sum(axis=1)
            return nx[:, None] + nq - 2 * (x @ q.T), 1e-11 * float(np.max(nx, initial=0) + np.max(nq, initial=0))
        u, v = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        return 1.0 - u @ v.T, 1e-11


@dataclass
class Block:
    """Questions: ordinal numbers, vectors, k of each, and their filter patterns as
    (active columns, {values: rows of the block})."""

    ids: np.ndarray
    vectors: np.ndarray
    k: np.ndarray
    patterns: list[tuple[tuple[int, ...], dict[tuple[str, ...], np.ndarray]]]


def make_block(rows: list, filters: int) -> Block:
    """``rows`` hold n (ordinal), v (vector), k and f0, f1, ... (text or null)."""
    groups: dict[tuple[int, ...], dict[tuple[str, ...], list[int]]] = {}
    for i, r in enumerate(rows):
        active = tuple(j for j in range(filters) if r[f"f{j}"] is not None)
        groups.setdefault(active, {}).setdefault(tuple(r[f"f{j}"] for j in active), []).append(i)
    return Block(np.array([r["n"] for r in rows], np.int64), np.array([r["v"] for r in rows], float),
                 np.array([r["k"] for r in rows], np.int64),
                 [(a, {key: np.array(v) for key, v in g.items()}) for a, g in sorted(groups.items())])


def meetings(block: Block, columns: list[pa.Array]) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
    """(rows of the batch, rows of the block) that pass each other's filters; None: all rows."""
    coded = [c.dictionary_encode() for c in columns]
    codes = [pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in coded]
    names = [{v: i for i, v in enumerate(c.dictionary.to_pylist())} for c in coded]
    for active, groups in block.patterns:
        if not active:
            yield None, groups[()]
            continue
        combined = np.zeros(len(codes[0]), np.int64)
        known = np.ones(len(codes[0]), bool)
        for j in active:
            combined = combined * (len(names[j]) + 1) + codes[j]
            known &= codes[j] >= 0
        rows = np.flatnonzero(known)
        rows = rows[np.argsort(combined[rows], kind="stable")]
        ordered = combined[rows]
        for values, questions in groups.items():
            want = 0
            for j, v in zip(active, values, strict=True):
                code = names[j].get(v)
                if code is None:
                    break
                want = want * (len(names[j]) + 1) + code
            else:
                lo, hi = np.searchsorted(ordered, [want, want + 1])
                if hi > lo:
                    yield rows[lo:hi], questions


class FirstK:
    """The first k rows by (distance, key) of every question of a block seen so far."""

    def __init__(self, block: Block, metric: str):
        self.block, self.metric = block, metric
        self.q, self.dist = np.zeros(0, np.int64), np.zeros(0)
        self.keys: pa.Array | None = None
        self.worst = np.full(len(block.ids), np.inf)  # distance of a question's k-th row

    def add(self, keys: pa.Array, vectors: np.ndarray, columns: list[pa.Array]) -> None:
        found = []
        for rows, questions in meetings(self.block, columns):
            rows = np.arange(len(keys)) if rows is None else rows
            for s in range(0, len(rows), _ROWS):
                for t in range(0, len(questions), _COLUMNS):
                    found.append(self._near(vectors, rows[s:s + _ROWS], questions[t:t + _COLUMNS]))
        if not found:
            return
        r, q = (np.concatenate(x) for x in zip(*found, strict=True))
        dist = exact_distances(vectors[r], self.block.vectors[q], self.metric)
        r, q, dist = (x[np.isfinite(dist)] for x in (r, q, dist))
        if len(r):
            self._merge(keys.take(pa.array(r)), q, dist)

    def _near(self, vectors: np.ndarray, rows: np.ndarray, questions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, slack = _approximate(vectors[rows], self.block.vectors[questions], self.metric)
        k = self.block.k[questions]
        limit = self.worst[questions] ** 2 if self.metric == "l2" else self.worst[questions].copy()
        for size in np.unique(k[k < len(rows)]):
            same = k == size
            limit[same] = np.minimum(limit[same], np.partition(near[:, same], size - 1, axis=0)[size - 1])
        i, j = np.nonzero(near <= limit + (slack + 1e-9 * np.abs(np.where(np.isfinite(limit), limit, 0))))
        return rows[i], questions[j]

    def _merge(self, keys: pa.Array, q: np.ndarray, dist: np.ndarray) -> None:
        if self.keys is not None:
            keys = pa.concat_arrays([self.keys, keys])
            q, dist = np.concatenate([self.q, q]), np.concatenate([self.dist, dist])
        names = keys.unique()
        place = np.empty(len(names), np.int64)
        place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        code = place[pc.index_in(keys, names).to_numpy()]
        order = np.lexsort((code, dist, q))
        q, dist = q[order], dist[order]
        first = np.searchsorted(q, q)  # where the question's rows begin
        kept = np.arange(len(q)) - first < self.block.k[q]
        self.q, self.dist, self.keys = q[kept], dist[kept], keys.take(pa.array(order[kept]))
        count = np.bincount(self.q, minlength=len(self.worst))
        full = count >= self.block.k
        last = np.cumsum(count) - 1
        self.worst[full] = self.dist[last[full]]


def nearest(chunks: DataFrame, questions: DataFrame, filters: list[tuple[str, str]], metric: str, chunk_key: str,
            chunk_vec: str, q_key: str, q_vec: str, k_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """((q_key, chunk_key, dist), bound on its rows by the questions' k): for every question the first k rows of every task.

    Chunks without a key, and vectors that are null, hold null or non-finite values or differ in
    length from the question's, are near nothing; a null question value filters nothing, a null
    chunk value passes no filter.  Questions are numbered and cut into blocks by their keys'
    hash; each block is one scan of ``chunks``."""
    spark = chunks.sparkSession
    known = questions.select(F.col(q_key).alias("key"), F.col(q_vec).cast("array<double>").alias("v"),
                             F.col(k_col).cast("long").alias("k"),
                             *[F.col(qc).cast("string").alias(f"f{i}") for i, (qc, _) in enumerate(filters)])
    sound = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    known = known.where(sound("v") & (F.size("v") > 0))
    size = known.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).orderBy("dim").collect()
    key_type, question_type = (d.schema[c].dataType.simpleString() for d, c in ((chunks, chunk_key), (questions, q_key)))
    rows = chunks.select(F.col(chunk_key).alias("key"), F.col(chunk_vec).cast("array<double>").alias("v"),
                         *[F.col(cc).cast("string").alias(f"f{i}") for i, (_, cc) in enumerate(filters)])
    rows = rows.where(F.col("key").isNotNull() & sound("v"))
    out = spark.createDataFrame([], f"{q_key} {question_type}, {chunk_key} {key_type}, dist double")
    for group in size:
        dim = group["dim"]
        blocks = max(1, -(-group["n"] * dim * 8 // block_bytes))
        for b in range(blocks):
            part = known.where(F.size("v") == dim)
            if blocks > 1:
                part = part.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
            asked = part.collect()  # bounded: block_bytes of vectors
            if not asked:
                continue
            asked = [{**r.asDict(), "n": i} for i, r in enumerate(asked)]
            block = spark.sparkContext.broadcast(make_block(asked, len(filters)))

            def run(batches: Iterator[pa.RecordBatch], block=block, dim=dim) -> Iterator[pa.RecordBatch]:
                first = FirstK(block.value, metric)
                for batch in batches:
                    if batch.num_rows:
                        vectors = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, dim)
                        first.add(batch.column(0), vectors, [batch.column(2 + i) for i in range(len(filters))])
                if first.keys is not None:
                    yield pa.record_batch([pa.array(first.block.ids[first.q]), first.keys, pa.array(first.dist)], ["n", "key", "dist"])

            hits = rows.where(F.size("v") == dim).mapInArrow(run, f"n long, key {key_type}, dist double")
            names = spark.createDataFrame([(r["n"], r["key"]) for r in asked], f"n long, question {question_type}")
            hits = hits.join(F.broadcast(names), "n").select(  # bounded: the keys of the block
                F.col("question").alias(q_key), F.col("key").alias(chunk_key), "dist")
            out = out.unionAll(hits)
    return out, sum(g["k"] for g in size)
