"""Dense retrieval: exact kNN with pre-filter (JN-1, FLT-1) and post-filter with fallback (JN-2).

The questions are the small side: blocks of them, bounded in bytes, travel to the tasks, which
scan the chunk vectors once per block and compare by matrix products
(:mod:`annualis.operators.blocked_knn`).  A filtered question meets only the rows that hold its
values.  Every task keeps the first k rows per question, then ``row_number() <= k`` ranks them,
so neither the number of chunks nor a hot filter value grows what is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annualis.functions.vectors import vector_literal
from annualis.operators.blocked_knn import nearest
from annualis.session import DEFAULT_BROADCAST_ROWS

DEFAULT_K = 5


def _given(c: str):
    """A filter value that filters: not null, not empty, not zero."""
    v = F.trim(F.col(c).cast("string"))
    return v.isNotNull() & ~v.isin("", "0", "0.0")


def knn_prefilter(
    chunks: DataFrame,
    questions: DataFrame,
    filters: list[tuple[str, str]],
    k: int = DEFAULT_K,
    metric: str = "l2",
    chunk_key: str = "chunk_id",
    chunk_vec: str = "embedding",
    q_key: str = "qid",
    q_vec: str = "q_vec",
    q_top_k: str | None = None,
    keep: list[str] | None = None,
    q_decimals: int | None = None,
) -> DataFrame:
    """Nearest ``k`` chunks per question among the chunks that pass its filters.

    ``filters`` pairs a question column with a chunk column; a null question value means
    "no filter" for that column.  ``q_top_k`` names a question column with its own k, as large
    as asked for (not positive or null: 5), which takes the place of ``k``.  Returns (q_key, chunk_key,
    dist, rank) plus ``keep`` chunk columns, which are read for the hits only.  Ties are broken by
    the chunk key.  ``q_decimals`` sends the question vectors through their text literal first (TXT-9), so
    they are rounded as a vector store gets them.  Chunks without a key or a finite vector of the question's length are no hits;
    a chunk with a null metadata value passes no filter on it.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    k = k if k > 0 else DEFAULT_K
    own = F.lit(k) if q_top_k is None else F.when(F.col(q_top_k) > 0, F.col(q_top_k)).otherwise(F.lit(DEFAULT_K))
    asked = questions.withColumn("_k", own)
    if q_decimals is not None:
        asked = asked.withColumn(q_vec, F.from_json(vector_literal(q_vec, q_decimals), "array<double>"))
    near, most = nearest(chunks, asked, filters, metric, chunk_key, chunk_vec, q_key, q_vec, "_k")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(q_key).orderBy("dist", chunk_key)))
    if q_top_k is None:
        ranked = ranked.where(F.col("rank") <= k)
    else:
        ranked = ranked.join(asked.select(q_key, "_k"), q_key).where(F.col("rank") <= F.col("_k")).drop("_k")
    out = ranked.select(q_key, chunk_key, "dist", "rank")
    if not keep:
        return out
    # the hits are bounded by the questions' k, the chunks are not
    hits = F.broadcast(out) if most <= DEFAULT_BROADCAST_ROWS else out
    return chunks.select(chunk_key, *[c for c in dict.fromkeys(keep) if c != chunk_key]).join(hits, chunk_key) \
        .select(q_key, chunk_key, "dist", "rank", *keep)


def knn_postfilter(
    chunks: DataFrame,
    questions: DataFrame,
    filters: list[tuple[str, str]],
    k: int = DEFAULT_K,
    max_k: int = 20,
    metric: str = "l2",
    chunk_key: str = "chunk_id",
    chunk_vec: str = "embedding",
    q_key: str = "qid",
    q_vec: str = "q_vec",
    q_top_k: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Nearest min(max_k, k) over *all* chunks, then the filter; if a filtered question
    keeps nothing, it gets the unfiltered hits back.  ``q_top_k`` names a question column with its
    own k (not positive or null: 5).  Null, empty and zero filter values
    filter nothing.  ``rank`` is 0-based and taken
    before filtering."""
    keep = keep or []
    fcols = [cc for _, cc in filters]
    asked = F.lit(k if k > 0 else DEFAULT_K) if q_top_k is None else \
        F.when(F.col(q_top_k) > 0, F.col(q_top_k)).otherwise(F.lit(DEFAULT_K))
    q = questions.select(q_key, q_vec, *[qc for qc, _ in filters], F.least(F.lit(max_k), asked).alias("_top"))
    unfiltered = knn_prefilter(
        chunks, q, [], metric=metric, chunk_key=chunk_key, chunk_vec=chunk_vec, q_key=q_key, q_vec=q_vec,
        q_top_k="_top", keep=list(dict.fromkeys(fcols + keep)),
    )
    ranked = unfiltered.join(q.drop(q_vec, "_top"), q_key, "inner")
    match = F.lit(True)
    any_filter = F.lit(False)
    for qc, cc in filters:
        match = match & F.when(_given(qc), F.coalesce(F.col(cc) == F.col(qc), F.lit(False))).otherwise(True)
        any_filter = any_filter | _given(qc)
    w = Window.partitionBy(q_key)
    ranked = ranked.withColumn("_m", match).withColumn("_any", F.max(F.col("_m").cast("int")).over(w))
    kept = ranked.filter(F.col("_m") | ((F.col("_any") == 0) & any_filter))
    return kept.select(q_key, chunk_key, "dist", (F.col("rank") - 1).alias("rank"), *keep)
