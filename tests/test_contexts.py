"""Contexts of questions on a corpus larger than the twin's pool."""

from pyspark.sql import functions as F

from annualis import config as C
from annualis.operators.lexical import bm25_topk
from annualis.plans.pipeline import RERANK_K, preferred_filings, question_candidates, question_contexts, scored_filings
from annualis.sources.tables import filings


def test_companies_that_rank_low_keep_their_contexts(spark, tmpdir_path):
    words = " ".join(C.QUESTIONS.values())
    many = spark.range(10_050).select(F.col("id").alias("doc_id"), F.concat(F.lit(words + " word"), "id").alias("text"), F.lit("big").alias("source"))
    low = spark.range(20_000, 20_007).select(F.col("id").alias("doc_id"), F.lit(words + " other" * 400).alias("text"), F.lit("low").alias("source"))
    docs = many.unionAll(low).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    qv = spark.createDataFrame([(f"{c}|{k}", k, c, None, C.QUESTIONS[k]) for k in C.QUESTIONS for c in ("BIG", "LOW", "NONE")],
                               "qid string, category string, company string, year int, question string")
    by_rank = bm25_topk(filings(spark, tmpdir_path), C.questions_df(spark), k=20_000, q_key="category", q_text="question")
    ranked = {(r.category, r["rank"]): r.doc_id for r in by_rank.collect()}
    top: dict = {}
    for r in question_contexts(spark, tmpdir_path, qv=qv).collect():
        top.setdefault(r.qid, []).append((r.ctx_rank, r.doc_id, r.text.startswith(words)))
    for k in C.QUESTIONS:
        assert sorted(top[f"LOW|{k}"]) == [(i, ranked[k, 10_051 + i], True) for i in range(5)]
        assert sorted(top[f"BIG|{k}"]) == sorted(top[f"NONE|{k}"]) == [(i, ranked[k, 1 + i], True) for i in range(5)]
    sizes = {r.qid: r["count"] for r in question_contexts(spark, tmpdir_path, stage="prefer", qv=qv, with_text=False).groupBy("qid").count().collect()}
    assert all(sizes[f"LOW|{k}"] == 7 and sizes[f"BIG|{k}"] == sizes[f"NONE|{k}"] == RERANK_K for k in C.QUESTIONS)
    assert {r.qid.split("|")[0] for r in question_candidates(spark, tmpdir_path, qv=qv).select("qid").distinct().collect()} == {"BIG", "LOW", "NONE"}


def test_preferred_filings_are_not_cut(spark, tmpdir_path):
    words = " ".join(C.QUESTIONS.values())
    n = RERANK_K + 30
    docs = spark.range(n + 7).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(words), F.expr("repeat(' other', int(id % 50))")).alias("text"),
        F.when(F.col("id") < n, "big").when(F.col("id") < n + 5, "low").alias("source"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    qv = spark.createDataFrame([(f"{c}|{k}", k, c) for k in C.QUESTIONS for c in ("BIG", "LOW", "NONE", None)], "qid string, category string, company string")
    qv = qv.withColumn("qid", F.concat_ws("|", F.coalesce("company", F.lit("?")), "category"))
    scored = {(r.category, r.doc_id): r.score for r in scored_filings(spark, tmpdir_path).collect()}
    got: dict = {}
    for r in preferred_filings(spark, tmpdir_path, qv).collect():
        got.setdefault(r.qid, []).append((r.pref_rank, r.doc_id))
    for k in C.QUESTIONS:
        for company, ids in {"BIG": range(n), "LOW": range(n, n + 5), "NONE": range(n + 7), "?": range(n + 7)}.items():
            assert sorted(got[f"{company}|{k}"]) == list(enumerate(sorted(ids, key=lambda d: (-scored[k, d], d))))  # noqa: B023


def test_items_and_contexts_are_found_once(spark, tmpdir_path, monkeypatch):
    from annualis.operators import select as SL
    from annualis.plans import pipeline, q_metrics

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("Azure revenue growth was driven by azure. Sales").alias("text"), F.lit("a").alias("source"))
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    calls = []
    for mod, name in ((SL, "eval_items"), (pipeline, "scored_filings")):
        monkeypatch.setattr(mod, name, lambda *a, _f=getattr(mod, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    m = q_metrics.metrics_items(spark, tmpdir_path)
    assert m.count() > 0 and sorted(calls) == ["eval_items", "scored_filings"]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents.parquet") + plan.count("Relation [doc_id") <= 1  # the candidates' texts only


def test_category_words_before_the_pattern(spark):
    from annualis.operators.extract import category_match

    texts = ["SALES were driven By x", "sale driven by", "wholesales led by", "Gross Margin due to", "opex because of", None, "", "revenue"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[getattr(r, k) for r in df.select(category_match(F.col("t"), F.lit(k)).alias(k)).collect()] for k in C.QUESTIONS]
    assert got == [[i in hit for i in range(len(texts))] for hit in ((0,), (3,), (4,))]
