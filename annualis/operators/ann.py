"""Inverted-list nearest neighbours whose probing stops by a bound (JN-5), and the batch
embedder (TXT-8).

The index is a table of chunks in folders by list (the nearest k-means centre), each with its
distance to the centre; the lists' sizes and radii are its only other part.  A search probes
a question's nearest lists until they hold k chunks; the k-th distance found is a bound, and by
the triangle inequality a list whose centre is farther away than the bound plus its radius
holds nothing nearer.  The second pass reads the lists that are left, and in them only the chunks
whose distance to the centre differs from the question's by no more than the bound, so the
result is exact; how many lists are read depends on how well the vectors cluster.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annualis.operators.blocked_knn import Block, FirstK
from annualis.session import checkpoint_dir

#: Chunks per list the number of lists aims at, its bounds, and training rows per list.
LIST_SIZE, LEAST_LISTS, MOST_LISTS, TRAIN_PER_LIST = 4_000, 4, 4_096, 256
BLOCK_BYTES = 32 << 20


@dataclass
class Lists:
    """An index: where its chunks are (key, v, list, away), its centres, and per list the number of
    chunks and the largest distance to the centre."""

    path: str
    key: str
    key_type: str
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"key {self.key_type}, v array<double>, away double, list int").parquet(self.path)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and c, as exact as double precision of the differences."""
    out = np.empty((len(x), len(c)))
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _sound(c: str):
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def build_lists(chunks: DataFrame, chunk_key: str = "chunk_id", vec: str = "embedding", lists: int | None = None,
                path: str | None = None, seed: int = 42, max_iter: int = 10) -> Lists:
    """Index of ``chunks`` by L2 distance, written below ``path`` (default: the shared checkpoint folder).

    The number of lists follows the number of chunks (about 4,000 a list, at most 4,096); centres are
    fitted by Spark ML's k-means on about 256 rows a list, chosen by hash.  Chunks without a key or
    a finite vector of the most common length are not indexed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = chunks.sparkSession
    key_type = chunks.schema[chunk_key].dataType.simpleString()
    rows = chunks.select(F.col(chunk_key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.where(F.col("key").isNotNull() & _sound("v"))
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    if not shapes:
        rows.select("key", "v", F.lit(0).alias("list"), F.lit(0.0).alias("away")).write.partitionBy("list").parquet(path)
        return Lists(path, chunk_key, key_type, np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0))
    dim, n = shapes[0]
    lists = lists or min(MOST_LISTS, max(LEAST_LISTS, math.ceil(n / LIST_SIZE)))
    rows = rows.where(F.size("v") == dim)
    parts = 1 << 20
    share = min(parts, math.ceil(parts * TRAIN_PER_LIST * lists / n))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) < share)
    sample = sample if sample.limit(1).count() else rows
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    known = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, -1), known.value)
                near = d.argmin(axis=1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                                      ["key", "v", "list", "away"])

    placed = rows.mapInArrow(assign, f"key {key_type}, v array<double>, list int, away double")
    # a list of a third of all chunks is split over several files by the range of its distances
    placed.repartitionByRange("list", "away").sortWithinPartitions("list", "away").write.partitionBy("list").parquet(path)
    facts = Lists(path, chunk_key, key_type, centres, np.zeros(0), np.zeros(0)).chunks(spark).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for f in facts:
        sizes[f["list"]], radii[f["list"]] = f["n"], f["r"]
    return Lists(path, chunk_key, key_type, centres, sizes, radii)


def _probe(index: Lists, spark: SparkSession, block: Block, probes: list[np.ndarray], away: np.ndarray, bound: np.ndarray, metric: str) -> DataFrame:
    """(n, key, dist): the first k chunks per question and task in the lists that it probes; ``bound``
    is the distance beyond which a chunk is of no use."""
    groups: dict[tuple[str, ...], list[int]] = {}
    for q, lists in enumerate(probes):
        for j in lists.tolist():
            groups.setdefault((str(j),), []).append(q)
    block.patterns = [((0,), {k: np.array(v) for k, v in groups.items()})]
    # per list, the least and greatest distance to the centre that any question can use
    low = {int(k[0]): float(min(away[q, int(k[0])] - bound[q] for q in v)) for k, v in groups.items()}
    high = {int(k[0]): float(max(away[q, int(k[0])] + bound[q] for q in v)) for k, v in groups.items()}
    dim = block.vectors.shape[1]
    known = spark.sparkContext.broadcast((block, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = known.value
        first = FirstK(block, metric)
        for b in batches:
            if not b.num_rows:
                continue
            at, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            lo, hi = (np.array([x[j] for j in at.tolist()]) for x in (low, high))
            slack = 1e-9 * (1 + np.abs(d))
            use = pa.array((d >= lo - slack) & (d <= hi + slack))
            b = b.filter(use)
            if b.num_rows:
                v = np.asarray(b.column(1).flatten(), float).reshape(b.num_rows, dim)
                first.add(b.column(0), v, [pa.array([str(x) for x in b.column(2).to_pylist()])])
        if first.keys is not None:
            yield pa.record_batch([pa.array(first.block.ids[first.q]), first.keys, pa.array(first.dist)], ["n", "key", "dist"])

    chunks = index.chunks(spark)
    used = sorted(int(k[0]) for k in groups)
    rows = chunks.where(F.col("list").isin(used)).select("key", "v", "list", "away")  # prunes folders
    return rows.mapInArrow(run, f"n long, key {index.key_type}, dist double")


def search_lists(index: Lists, questions: DataFrame, k: int = 5, q_key: str = "qid", q_vec: str = "q_vec") -> DataFrame:
    """(q_key, chunk key, dist, rank): the ``k`` nearest chunks of every question, exactly, ties by
    key.  Questions are taken in blocks of bounded size; those without a finite vector of the index's
    length have no hits."""
    spark = questions.sparkSession
    key_type = index.key_type
    q_type = questions.schema[q_key].dataType.simpleString()
    out = spark.createDataFrame([], f"{q_key} {q_type}, {index.key} {key_type}, dist double")
    dim = index.centres.shape[1]
    asked = questions.select(F.col(q_key).alias("key"), F.col(q_vec).cast("array<double>").alias("v"))
    asked = asked.where(_sound("v") & (F.size("v") == dim))
    blocks = max(1, -(-asked.count() * max(dim, 1) * 8 // BLOCK_BYTES)) if dim else 0
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # bounded: BLOCK_BYTES of vectors
        if not rows:
            continue
        v = np.array([r["v"] for r in rows])
        block = Block(np.arange(len(rows)), v, np.full(len(rows), k), [])
        away = _distances(v, index.centres)
        first = []
        for d in away:
            order = np.argsort(d, kind="stable")
            first.append(order[:int(np.searchsorted(np.cumsum(index.sizes[order]), k)) + 1])
        near = _probe(index, spark, block, first, away, np.full(len(rows), np.inf), "l2")
        w = Window.partitionBy("n").orderBy("dist", "key")
        near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        bound = np.full(len(rows), np.inf)
        for r in near.where(F.col("_r") == k).select("n", "dist").collect():  # one number per question of the block
            bound[r["n"]] = r["dist"]
        probes = [np.flatnonzero((d - index.radii <= t * (1 + 1e-9) + 1e-12) & (index.sizes > 0)) for d, t in zip(away, bound, strict=True)]
        hits = _probe(index, spark, block, probes, away, bound, "l2")
        names = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], f"n long, name {q_type}")
        out = out.unionAll(hits.join(F.broadcast(names), "n").select("name", "key", "dist"))  # bounded: the block's keys
    w = Window.partitionBy(q_key).orderBy("dist", index.key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ann_topk(chunks: DataFrame, questions: DataFrame, k: int = 5, lists: int | None = None, chunk_key: str = "chunk_id",
             vec: str = "embedding", q_key: str = "qid", q_vec: str = "q_vec") -> DataFrame:
    """Index and search in one go."""
    return search_lists(build_lists(chunks, chunk_key, vec, lists), questions, k, q_key, q_vec)


# ---------------------------------------------------------------------------- embedder

_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashed_embedder(dim: int = 64):
    """Default embedder: hashed bag of lower-cased words, L2-normalised (float32).
    Any callable ``list[str] -> np.ndarray (n, dim)`` can replace it.  A batch's words are hashed
    and counted together."""
    def embed(texts: list[str]) -> np.ndarray:
        words = [_TOKEN.findall((t or "").lower()) for t in texts]
        n = [len(w) for w in words]
        out = np.zeros((len(texts), dim), dtype=np.float32)
        if sum(n):
            h = pd.util.hash_array(np.array([x for w in words for x in w], dtype=object), categorize=True) % dim
            place = np.repeat(np.arange(len(texts)), n) * dim + h.astype(np.int64)
            out = np.bincount(place, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return embed


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding", embed_fn=None, dim: int = 64) -> DataFrame:
    """TXT-8: batch embedding through an Arrow-batched pandas UDF (model built once per
    worker process by the closure); empty input gives zero rows."""
    fn = embed_fn or hashed_embedder(dim)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(fn(texts.fillna("").tolist())))

    return df.withColumn(out_col, _embed(F.col(text_col)))
