"""Ranking, cuts and context packing per question (WIN-1..8, WIN-10..12, SEL-7).

All per-question state is either a window over an already ranked, bounded set of
hits (at most the retrieval k per question) or a running sum; no operator gathers an
unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annualis import config as C


def keep_first(hits: DataFrame, n: int = C.RERANK_KEEP, rank_col: str = "rank") -> DataFrame:
    """WIN-3: the first max(n, 1) hits (ranks are 1-based)."""
    return hits.filter(F.col(rank_col) <= max(n, 1))


def pack_chars(hits: DataFrame, q_key: str = "qid", rank_col: str = "rank", text_col: str = "text",
               max_chars: int = C.MAX_CONTEXT_CHARS) -> DataFrame:
    """WIN-4: longest rank prefix whose sum of (len(text) + 2) stays within ``max_chars``.

    Lengths are >= 2 so the running sum is monotone and "stop at the first overflow"
    equals "running sum <= budget".  Returns the kept hit rows with ``used_chars``.
    """
    w = Window.partitionBy(q_key).orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0)
    t = F.coalesce(F.col(text_col), F.lit(""))
    return (hits.withColumn(text_col, t)
            .withColumn("used_chars", F.sum(F.length(t) + 2).over(w))
            .filter(F.col("used_chars") <= max_chars))


def join_context(kept: DataFrame, q_key: str = "qid", rank_col: str = "rank", text_col: str = "text",
                 sep: str = "\n\n") -> DataFrame:
    """Packed context text per question (bounded group: at most the kept hits)."""
    return kept.groupBy(q_key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t")))),
                        lambda x: x["t"]),
            sep,
        ).alias("context"),
        F.count(F.lit(1)).alias("n_contexts"),
        F.min_by(F.col(text_col), F.col(rank_col)).alias("first_context"),
    )


def local_answer(questions: DataFrame, kept: DataFrame, q_key: str = "qid", rank_col: str = "rank",
                 text_col: str = "text") -> DataFrame:
    """SEL-7: first kept context, else the fixed no-context message; one row per question."""
    ctx = join_context(kept, q_key, rank_col, text_col)
    return questions.join(ctx, q_key, "left").select(
        q_key,
        F.coalesce(F.col("first_context"), F.lit(C.NO_CONTEXT_ANSWER)).alias("answer"),
        F.coalesce(F.col("context"), F.lit("")).alias("context"),
        F.coalesce(F.col("n_contexts"), F.lit(0)).cast("long").alias("n_contexts"),
    )


def pack_tokens(hits: DataFrame, tokens_col: str, q_key: str = "qid", rank_col: str = "rank",
                limit: int = C.PACK_TOKEN_LIMIT) -> DataFrame:
    """WIN-5: fill up to ``limit`` tokens in rank order, cutting the last chunk to what remains.

    Adds ``prev_tokens`` (tokens used before this hit) and ``take`` (the kept token slice);
    hits that start at or past the limit are dropped.
    """
    w = Window.partitionBy(q_key).orderBy(rank_col).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.sum(F.size(tokens_col)).over(w), F.lit(0))
    out = hits.withColumn("prev_tokens", prev).filter(F.col("prev_tokens") < limit)
    return out.withColumn("take", F.slice(tokens_col, 1, F.greatest(F.lit(0), F.lit(limit) - F.col("prev_tokens"))))


def rerank(hits: DataFrame, score: Column | None = None, q_key: str = "qid", in_rank: str = "rank",
           top_k: int = C.DEFAULT_TOP_K, out_rank: str = "rr_rank") -> DataFrame:
    """WIN-1: order each question's hits by score (desc, stable on the input rank), keep top_k.

    ``score`` defaults to the reference's fallback: 1.0 for every pair, i.e. input order.
    """
    s = score if score is not None else F.lit(1.0)
    scored = hits.withColumn("ce_score", s.cast("double"))
    w = Window.partitionBy(q_key).orderBy(F.col("ce_score").desc(), F.col(in_rank))
    return scored.withColumn(out_rank, F.row_number().over(w)).filter(F.col(out_rank) <= top_k)


def compress(hits: DataFrame, score: Column | None = None, q_key: str = "qid", in_rank: str = "rank",
             top_k: int = C.DEFAULT_TOP_K) -> DataFrame:
    """WIN-2: rerank, keep top_k, drop the scores (same document shape as the input)."""
    return rerank(hits, score, q_key, in_rank, top_k).drop("ce_score")


def overlap_score(question_col: str, text_col: str) -> Column:
    """Token-set F1 between question and passage: a deterministic, JVM-side pair scorer."""
    from annualis.functions.text import token_f1
    return token_f1(F.col(text_col), F.col(question_col))


def prefer_group(df: DataFrame, q_key: str, flag: Column) -> DataFrame:
    """WIN-7: keep the rows where ``flag`` holds if the question has any, else all rows."""
    w = Window.partitionBy(q_key)
    return (df.withColumn("_f", flag.cast("boolean"))
            .withColumn("_anyf", F.max(F.col("_f").cast("int")).over(w))
            .filter(F.col("_f") | (F.col("_anyf") == 0))
            .drop("_f", "_anyf"))


def priority_top(df: DataFrame, q_key: str, priority: Column, in_rank: str, keys: list[str], n: int = 5,
                 out_rank: str = "prio_rank") -> DataFrame:
    """WIN-6: rows with ``priority`` first, then the rest, each key once, first ``n``."""
    d = df.withColumn("_p", priority.cast("boolean"))
    wdup = Window.partitionBy(q_key, *keys).orderBy(F.col("_p").desc(), F.col(in_rank))
    d = d.withColumn("_dup", F.row_number().over(wdup)).filter(F.col("_dup") == 1)
    w = Window.partitionBy(q_key).orderBy(F.col("_p").desc(), F.col(in_rank))
    return d.withColumn(out_rank, F.row_number().over(w)).filter(F.col(out_rank) <= n).drop("_dup")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "grp_rank") -> DataFrame:
    """WIN-8 / WIN-11: at most ``n`` rows per key group, in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def seeded_shuffle_limit(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """WIN-12: repeatable shuffle (md5 of id and seed), then the first n (n <= 0: all).
    ``orderBy(...).limit(n)`` plans as a distributed top-n (TakeOrderedAndProject)."""
    out = df.withColumn("shuffle_key", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))))
    return out.orderBy("shuffle_key", id_col).limit(n) if n > 0 else out
