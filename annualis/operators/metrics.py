"""Evaluation metrics (MET-*) and their aggregations (AGG-*).

Per-item metrics are row expressions over the prediction, the gold answer and the
item's (at most five) contexts.  Summaries are single ``agg`` calls (partial
aggregation, one tiny final row).  Exact percentiles are computed without putting a
group's values into one buffer: distinct values with their counts get an exclusive
prefix sum (range buckets, see :func:`annualis.operators.prefix.prefix_sums`),
and the interpolated ranks are picked with a conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.operators.prefix import prefix_sums
from annualis.session import cut_lineage


def context_metrics(contexts: Column, gold: Column) -> dict[str, Column]:
    """MET-4/5/8 over an ordered array of context texts."""
    g = TX.normalize_answer(gold)
    hits = F.transform(contexts, lambda c: F.contains(TX.normalize_answer(c), g))
    n = F.size(contexts)
    pos = F.array_position(hits, F.lit(True))
    first = F.when((g != "") & (pos > 0), pos.cast("int"))
    rr = F.coalesce(F.lit(1.0) / first, F.lit(0.0))
    ctx_tokens = F.transform(contexts, lambda c: F.size(TX.answer_tokens(c)))
    return {
        "retrieval_hit": F.when(g == "", F.lit(0)).otherwise(F.exists(hits, lambda h: h).cast("int")),
        "context_hit_rate": F.when((g == "") | (n == 0), F.lit(0.0)).otherwise(
            F.size(F.filter(hits, lambda h: h)) / F.greatest(n, F.lit(1))),
        "first_hit_rank": first,
        "reciprocal_rank": rr,
        "hit_at_1": F.coalesce((first <= 1).cast("int"), F.lit(0)),
        "hit_at_3": F.coalesce((first <= 3).cast("int"), F.lit(0)),
        "hit_at_5": F.coalesce((first <= 5).cast("int"), F.lit(0)),
        "avg_context_len_tokens": F.when(n == 0, F.lit(0.0)).otherwise(
            F.aggregate(ctx_tokens, F.lit(0), lambda a, x: a + x) / n),
    }


def answer_metrics(pred: Column, gold: Column) -> dict[str, Column]:
    """MET-1/2/3/6/7/8."""
    return {
        "exact_match": TX.exact_match(pred, gold),
        "contains_match": TX.contains_match(pred, gold),
        "token_f1": TX.token_f1(pred, gold),
        "em_raw": (F.lower(gold) == F.lower(pred)).cast("int"),
        "em_canonical": (TX.canonicalize(F.lower(gold)) == TX.canonicalize(F.lower(pred))).cast("int"),
        "em_contains": F.contains(F.lower(pred), gold).cast("int"),
        "answer_len_tokens": F.size(TX.answer_tokens(pred)),
    }


def quality_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-5 (+AGG-1 empty -> 0): one row of mean item metrics, or one per group of ``by``."""
    def mean(c):
        return F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return items.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_success"),
        *[mean(c).alias(c) for c in ["exact_match", "contains_match", "token_f1", "retrieval_hit",
                                      "context_hit_rate"]],
        mean("reciprocal_rank").alias("mrr"),
        mean("hit_at_1").alias("hit_at_1"), mean("hit_at_3").alias("hit_at_3"), mean("hit_at_5").alias("hit_at_5"),
        mean("answer_len_tokens").alias("answer_len_tokens_mean"),
        mean("avg_context_len_tokens").alias("avg_context_len_tokens_mean"),
    )


def by_category(items: DataFrame, cat_col: str = "category") -> DataFrame:
    """AGG-6: overall and per-category n, recall@5, EM, canonical EM (rollup); items without a
    category are a bucket of their own, null, not a second overall row."""
    return items.rollup(cat_col).agg(
        F.grouping(cat_col).alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("recall_at_5").cast("double")).alias("recall_at_5"),
        F.avg(F.col("em_raw").cast("double")).alias("em"),
        F.avg(F.col("em_canonical").cast("double")).alias("em_canonical"),
    ).withColumn("bucket", F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col(cat_col))).drop(cat_col, "_all")


def status_ok(code: str | Column) -> Column:
    """FLT-7: a request succeeded if its status code is there and from 200 to 299."""
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce(c.between(200, 299), F.lit(False))


def value_counts(df: DataFrame, col: str, groups: dict[str, Column]) -> DataFrame:
    """(v, n_<group>...) per distinct value, null included: how many rows of each group have it."""
    return df.groupBy(F.col(col).cast("double").alias("v")).agg(
        *[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"n_{g}") for g, cond in groups.items()])


def exact_percentiles(counts: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    """AGG-2: one row with ``<group>_p<q>`` (q in percent): linear-interpolation percentiles of the
    groups of :func:`value_counts`, empty -> 0.

    ``pos = q (n - 1)``, value = x[lo] + (x[hi] - x[lo]) * frac over the sorted values.  All
    groups and ranks come from one running sum over the distinct values and one aggregate."""
    placed = prefix_sums(counts.where("v is not null"), ["v"], {f"o_{g}": f"n_{g}" for g in groups})
    totals = counts.where("v is not null").agg(*[F.coalesce(F.sum(f"n_{g}"), F.lit(0)).alias(g) for g in groups]) \
        .select(F.struct(*groups)).scalar()
    placed = placed.withColumn("_n", totals)
    picks = []
    for g in groups:
        for q in qs:
            pos = (F.col(f"_n.{g}") - 1) * F.lit(q)
            lo = F.floor(pos)
            hi = F.least(lo + 1, F.col(f"_n.{g}") - 1)
            at = lambda r: F.max(F.when((F.col(f"o_{g}") <= r) & (r < F.col(f"o_{g}") + F.col(f"n_{g}")), F.col("v")))  # noqa: B023, E731
            x, y, frac = at(lo), at(hi), F.max(pos - lo)
            picks.append(F.coalesce(x + (y - x) * frac, F.lit(0.0)).alias(f"{g}_p{q * 100:g}"))
    return placed.agg(*picks)


def round_half_binary(c, digits: int = 2) -> Column:
    """Round half away from zero on the binary value (x * 10^d, then floor(+0.5)), like
    C's round() and Python's round() on these magnitudes; Spark's ``round`` decides
    half-way cases on the shortest decimal string instead (145.605 -> 145.61, not 145.6)."""
    x = c if isinstance(c, Column) else F.col(c)
    k = float(10 ** digits)
    return F.signum(x) * F.floor(F.abs(x) * k + 0.5) / k


def latency_summary(requests: DataFrame, latency_col: str = "latency_ms", ok_col: str = "ok") -> DataFrame:
    """AGG-3 + AGG-4 + FLT-7: request counts and mean / p50 / p95 / max latency over all
    requests and over successful ones only, rounded to 2 decimals (empty -> 0).  A request whose
    ``ok`` is null has failed; one without a latency counts, but not for the latencies.

    The requests are scanned once, into counts per distinct latency."""
    counts = cut_lineage(value_counts(requests, latency_col, {"all": F.lit(True), "ok": F.col(ok_col)}))
    pct = exact_percentiles(counts, ["all", "ok"], [0.5, 0.95])
    some = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda n: some(F.sum(F.col("v") * F.col(n)) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col(n))), F.lit(0)))
    agg = counts.agg(
        F.coalesce(F.sum("n_all"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum(F.col("n_all") - F.col("n_ok")), F.lit(0)).alias("failed_requests"),
        mean("n_all").alias("_m_all"), some(F.max("v")).alias("_x_all"),
        mean("n_ok").alias("_m_ok"), some(F.max(F.when(F.col("n_ok") > 0, F.col("v")))).alias("_x_ok"),
    ).withColumn("_p", pct.select(F.struct("*")).scalar())
    r2 = round_half_binary
    return agg.select(
        "n_items", "failed_requests",
        F.when(F.col("n_items") > 0, (F.col("n_items") - F.col("failed_requests")) / F.col("n_items"))
        .otherwise(F.lit(0.0)).alias("request_success_rate"),
        r2("_m_all").alias("all_mean_ms"), r2("_p.all_p50").alias("all_p50_ms"),
        r2("_p.all_p95").alias("all_p95_ms"), r2("_x_all").alias("all_max_ms"),
        r2("_m_ok").alias("ok_mean_ms"), r2("_p.ok_p50").alias("ok_p50_ms"),
        r2("_p.ok_p95").alias("ok_p95_ms"), r2("_x_ok").alias("ok_max_ms"),
    )
