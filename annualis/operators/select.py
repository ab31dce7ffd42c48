"""Candidate selection and the learned selector (SEL-1..8, WIN-9/10, JN-13).

Selection is per question over its candidates (a few per context, five contexts):
"filter, or keep everything when the filter would empty the pool" is a windowed max
flag, the pick is ``row_number() = 1``.  Training uses Spark ML's logistic regression
(distributed L-BFGS); prediction is a plain ``transform``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators import rank as R


FEATURE_PREFIX = "f_"
FEATURE_COLS = [FEATURE_PREFIX + n for n in C.FEATURE_NAMES]


def aligned(subj: Column, cand: Column) -> Column:
    return F.coalesce(F.arrays_overlap(subj, cand), F.lit(False))


def answer_group(ans_can: Column) -> Column:
    """SEL-6: group of a canonical answer, first matching rule wins."""
    out = F.lit(None).cast("string")
    for g, subs in reversed(C.ANSWER_GROUPS):
        cond = F.lit(False)
        for sub in subs:
            cond = cond | F.contains(ans_can, F.lit(sub))
        out = F.when(cond, F.lit(g)).otherwise(out)
    return out


def select_heuristic(cands: DataFrame, q_key: str = "qid", category_col: str = "category",
                     hint_col: str | None = None) -> DataFrame:
    """SEL-2: (1) hint group filter if it keeps any, (2) for revenue the aligned filter if
    it keeps any, (3) aligned desc, ce_score desc, ctx_rank asc, then sequence order."""
    c = cands
    if hint_col is not None:
        c = R.prefer_group(c, q_key, F.coalesce(F.array_contains("cand_groups", F.col(hint_col)), F.lit(False)))
    al = (F.size("subj_groups") > 0) & aligned(F.col("subj_groups"), F.col("cand_groups"))
    c = R.prefer_group(c, q_key, (F.coalesce(F.col(category_col), F.lit("")) != "revenue_driver") | al)
    w = Window.partitionBy(q_key).orderBy(aligned(F.col("subj_groups"), F.col("cand_groups")).desc(),
                                          F.col("ce_score").desc(), F.col("ctx_rank"), F.col("sent_pos"), F.col("patt_pos"))
    return c.withColumn("_pick", F.row_number().over(w)).filter(F.col("_pick") == 1).drop("_pick")


def features(cands: DataFrame, category_col: str = "category") -> DataFrame:
    """SEL-1: the 16 selector features, in the fixed order, as double columns ``f_<name>``."""
    cg = F.col("cand_groups")
    cat = F.coalesce(F.col(category_col), F.lit(""))
    cols = {
        "bias": F.lit(1.0),
        "ctx_rank": F.col("ctx_rank").cast("double"),
        "ctx_rank_inv": 1.0 / (1 + F.col("ctx_rank").cast("double")),
        "ce_score": F.col("ce_score").cast("double"),
        "len_words": F.size(F.split(TX.strip_ws(F.col("phrase")), r"\s+")).cast("double"),
        "subj_any": (F.size("subj_groups") > 0).cast("double"),
    }
    for g in C.GROUP_NAMES:
        cols[f"g_{g}"] = F.array_contains(cg, g).cast("double")
    cols["align"] = aligned(F.col("subj_groups"), cg).cast("double")
    cols["cat_rev"] = (cat == "revenue_driver").cast("double")
    cols["cat_margin"] = (cat == "margin_driver").cast("double")
    cols["cat_opex"] = (cat == "opex_driver").cast("double")
    # python's "".split() is [], Spark's split("") is [""]
    cols["len_words"] = F.when(TX.strip_ws(F.col("phrase")) == "", F.lit(0.0)).otherwise(cols["len_words"])
    return cands.select("*", *[cols[n].alias(FEATURE_PREFIX + n) for n in C.FEATURE_NAMES])


def segment_drivers(cands: DataFrame, q_key: str = "qid") -> DataFrame:
    """JN-13: per question and segment, the best candidate of that segment's group, else
    the overall best candidate (same ordering as the heuristic select)."""
    order = [aligned(F.col("subj_groups"), F.col("cand_groups")).desc(), F.col("ce_score").desc(),
             F.col("ctx_rank"), F.col("sent_pos"), F.col("patt_pos")]
    best_all = (cands.withColumn("_r", F.row_number().over(Window.partitionBy(q_key).orderBy(*order)))
                .filter("_r = 1").select(q_key, F.col("phrase").alias("_overall")))
    segs = F.array(*[F.lit(g) for g in C.SEGMENTS])
    per_seg = (cands.select("*", F.explode(segs).alias("segment"))
               .filter(F.array_contains("cand_groups", F.col("segment"))))
    best_seg = (per_seg.withColumn("_r", F.row_number().over(Window.partitionBy(q_key, "segment").orderBy(*order)))
                .filter("_r = 1").select(q_key, "segment", F.col("phrase").alias("_seg")))
    grid = best_all.select(q_key, "_overall", F.explode(segs).alias("segment"))
    out = grid.join(best_seg, [q_key, "segment"], "left")
    return out.select(q_key, "segment", F.coalesce("_seg", "_overall").alias("phrase"),
                      F.col("_seg").isNotNull().cast("int").alias("from_segment"))


def eval_items(chunks: DataFrame, companies: list[str] | None = None, years: list[int] | None = None,
               max_per_cat: int = 6) -> DataFrame:
    """SEL-8: eval-set rows (question, company, year, category, answer, chunk_id, doc_id).

    Companies upper-cased (FLT-3), years only when given; a driver cue must be present;
    each category whose anchor occurs adds one row per seed key contained; first row per
    (company, year, category, answer) wins (AGG-7); at most ``max_per_cat`` per
    (company, year, category) in chunk order (WIN-8)."""
    c = chunks
    if companies is not None:
        c = c.filter(F.col("company").isin([x.upper() for x in companies]))
    if years:
        c = c.filter(F.col("year").cast("int").isin([int(y) for y in years]))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tl = F.lower(t)
    c = c.filter(t.rlike("(?i)" + C.CUE_ANY)).withColumn("_low", tl)
    tl = F.col("_low")
    seeds = []
    for ci, (cat, keys) in enumerate(C.EVAL_SEED_KEYS.items()):
        for ki, key in enumerate(keys):
            cond = F.contains(tl, F.lit(key)) & tl.rlike("(?i)" + C.CATEGORY_REGEX[cat])  # the cheap test first
            seeds.append(F.when(cond, F.struct(F.lit(cat).alias("category"), F.lit(key.lower().strip()).alias("answer"),
                                                F.lit(ci).alias("_ci"), F.lit(ki).alias("_ki"))))
    rows = c.select("chunk_id", "doc_id", "company", "year", F.inline(F.array_compact(F.array(*seeds))))
    w1 = Window.partitionBy("company", "year", "category", "answer").orderBy("chunk_id", "_ci", "_ki")
    rows = rows.withColumn("_r1", F.row_number().over(w1)).filter("_r1 = 1")
    w2 = Window.partitionBy("company", "year", "category").orderBy("chunk_id", "_ci", "_ki")
    rows = rows.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= max_per_cat)
    qmap = F.create_map(*[x for k, v in C.QUESTIONS.items() for x in (F.lit(k), F.lit(v))])
    return rows.select(
        F.concat_ws("|", "company", F.col("year").cast("string"), "category", "answer").alias("item_id"),
        qmap[F.col("category")].alias("question"), "company", F.col("year").cast("int").alias("year"),
        "category", "answer", "chunk_id", "doc_id")


def label_candidates(cands: DataFrame, gold_col: str = "answer", q_key: str = "qid") -> DataFrame:
    """SEL-4: label = canonical phrase equals canonical gold; questions without a positive
    are dropped whole."""
    lab = cands.withColumn("label", (TX.canonicalize(F.col("phrase")) == TX.canonicalize(F.col(gold_col))).cast("int"))
    w = Window.partitionBy(q_key)
    return lab.withColumn("_anypos", F.max("label").over(w)).filter("_anypos = 1").drop("_anypos")


def train_selector(rows: DataFrame, max_iter: int = 1000, tol: float = 1e-4):
    """SEL-5: class-balanced logistic regression (L2, C = 1 like the reference's default).

    Spark's objective is mean-loss + regParam * ||w||^2 / 2 over weighted rows, so C = 1
    over n rows is regParam = 1 / n; the balanced weight of class k is n / (2 n_k).
    ``tol`` 1e-4 mirrors the reference solver's default stopping tolerance.
    Returns None when there are no rows (the heuristic path is used then)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("npos")).first()
    n, npos = int(stats["n"] or 0), int(stats["npos"] or 0)
    if n == 0:
        return None
    nneg = n - npos
    wpos = n / (2.0 * npos) if npos else 0.0
    wneg = n / (2.0 * nneg) if nneg else 0.0
    va = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features")
    data = va.transform(rows).withColumn("w", F.when(F.col("label") == 1, F.lit(wpos)).otherwise(F.lit(wneg)))
    # L-BFGS makes one pass per iteration: materialise the (narrow) training matrix once
    # instead of re-running the extraction pipeline every iteration
    data = data.select("features", F.col("label").cast("double").alias("label"), "w").persist(StorageLevel.MEMORY_AND_DISK)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter, tol=tol,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False, fitIntercept=True)
    try:
        return lr.fit(data)
    finally:
        data.unpersist()


def score_candidates(model, cands_with_features: DataFrame) -> DataFrame:
    """SEL-3: probability of class 1 per candidate (``p``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    va = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features")
    out = model.transform(va.transform(cands_with_features))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def linear_weights(model) -> tuple[list[float], float]:
    """(weights in the order of the features, intercept) of a fitted selector: all that scoring needs."""
    return [float(x) for x in model.coefficients], float(model.intercept)


def score_linear(cands_with_features: DataFrame, weights: list[float], intercept: float) -> DataFrame:
    """SEL-3 from stored weights, without a model object: ``p`` = probability of class 1, as a native
    expression."""
    if len(weights) != len(FEATURE_COLS):
        raise ValueError(f"{len(weights)} weights for {len(FEATURE_COLS)} features")
    z = F.lit(float(intercept))
    for w, c in zip(weights, FEATURE_COLS, strict=True):
        z = z + F.lit(float(w)) * F.col(c)
    return cands_with_features.withColumn("p", 1.0 / (1.0 + F.exp(-z)))


def argmax_pick(scored: DataFrame, q_key: str = "qid", p_col: str = "p") -> DataFrame:
    """WIN-10: highest probability per question, first in sequence on ties."""
    w = Window.partitionBy(q_key).orderBy(F.col(p_col).desc(), "ctx_rank", "sent_pos", "patt_pos")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
