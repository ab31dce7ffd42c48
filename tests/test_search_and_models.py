"""Blocked kNN, list search, running sums, latency sketches and the model surfaces against brute
force and on odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.functions.vectors import hashed_embedding
from annualis.operators import ann as AN
from annualis.operators import blocked_knn as BK
from annualis.operators import generation as G
from annualis.operators import rank as R
from annualis.operators import retrieve as RT
from annualis.operators import scoring as SC
from annualis.operators.prefix import prefix_sums
from annualis.plans import q_streaming as QS
from annualis.streaming import requests as RQ

from conftest import SF_SMALL

CHUNK = "chunk_id string, embedding array<double>, company string, year int"
QUESTION = "qid long, q_vec array<double>, f_company string, f_year int, k int"


def _corpus(rng, n=400, dim=5):
    v = rng.integers(-3, 4, (n, dim)).astype(float)  # small integers: many exact ties
    v[n // 2:n // 2 + n // 3] = v[0]  # a third is one vector
    return [(f"c{i:04d}", v[i].tolist(), [None, "A", "B", "C"][i % 4], [2020, 2021, None][i % 3]) for i in range(n)]


def _brute(chunks, question, k, metric):
    qid, q, co, yr, _ = question
    hits = []
    for key, v, c, y in chunks:
        if (co is not None and co != c) or (yr is not None and yr != y) or v is None or len(v) != len(q):
            continue
        a, b = np.array(v), np.array(q)
        if metric == "l2":
            d = float(np.sqrt(((a - b) ** 2).sum()))
        else:
            if not a.any() or not b.any():
                continue
            d = float(1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
        hits.append((round(d, 9), key))
    return [(qid, key, r + 1) for r, (_, key) in enumerate(sorted(hits)[:k])]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocked_knn_against_brute_force(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    chunks = _corpus(rng)
    qs = [(i, rng.integers(-3, 4, 5).astype(float).tolist(), [None, "A", "Z"][i % 3], [None, 2020, 2021][i % 4 % 3], [0, 1, 7, 500, None][i % 5])
          for i in range(30)]
    odd = [("n1", None, "A", 2020), ("n2", [1.0], "A", 2020), ("n3", [float("nan")] * 5, "A", 2020), (None, [0.0] * 5, "A", 2020), ("n4", [0.0] * 5, "A", 2020)]
    c = spark.createDataFrame(chunks + odd, CHUNK).repartition(3)
    q = spark.createDataFrame(qs + [(99, None, None, None, 3), (98, [float("inf")] * 5, None, None, 3)], QUESTION)
    monkeypatch.setattr(BK, "_ROWS", 37)
    monkeypatch.setattr(BK, "_COLUMNS", 4)
    got = RT.knn_prefilter(c, q, [("f_company", "company"), ("f_year", "year")], metric=metric, q_top_k="k", keep=["company"])
    rows = sorted((r.qid, r["rank"], r.chunk_id) for r in got.collect())
    want = [x for s in qs for x in _brute(chunks + odd[-1:], s, s[4] if s[4] else 5, metric)]
    if metric == "cosine":  # equal but for rounding: compare the distances by rank
        assert sorted((a, r) for a, r, _ in rows) == sorted((a, r) for a, _, r in want)
    else:
        assert rows == sorted((a, r, key) for a, key, r in want)
    assert got.columns == ["qid", "chunk_id", "dist", "rank", "company"]
    with pytest.raises(ValueError):
        RT.knn_prefilter(c, q, [], metric="l1")


def test_questions_beyond_a_block_are_scanned_block_by_block(spark):
    rng = np.random.default_rng(2)
    chunks = _corpus(rng, 120)
    c = spark.createDataFrame(chunks, CHUNK)
    q = spark.createDataFrame([(i, rng.integers(-3, 4, 5).astype(float).tolist(), None, None, 3) for i in range(40)], QUESTION)
    few, _ = BK.nearest(c, q, [], "l2", "chunk_id", "embedding", "qid", "q_vec", "k", block_bytes=400)
    one, most = BK.nearest(c, q, [], "l2", "chunk_id", "embedding", "qid", "q_vec", "k")
    top = lambda d: {q: sorted(x)[:3] for q, x in _by(d).items()}
    assert top(few) == top(one) and most == 120
    assert RT.knn_prefilter(c.limit(0), q, []).collect() == [] and RT.knn_prefilter(c, q.limit(0), []).collect() == []


def _by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.dist, r.chunk_id))
    return out


def test_postfilter_takes_each_questions_own_k(spark):
    rng = np.random.default_rng(3)
    chunks = _corpus(rng)
    c = spark.createDataFrame(chunks, CHUNK)
    q = spark.createDataFrame([(1, [0.0] * 5, "A", None, 3), (2, [0.0] * 5, "Z", None, 50), (3, [0.0] * 5, "", 0, None)], QUESTION)
    got = _by(RT.knn_postfilter(c, q, [("f_company", "company"), ("f_year", "year")], q_top_k="k"))
    assert len(got[2]) == 20 and len(got[3]) == 5 and len(got[1]) <= 3  # at most max_k; fallback; default


@pytest.mark.parametrize("lists", [None, 7])
def test_list_search_is_exact_and_reads_few_lists_of_clustered_vectors(spark, lists):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(7, 6)) * 50
    v = np.vstack([centres[i % 7] + rng.normal(size=6) for i in range(600)])
    v[300:400] = v[5]
    c = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [1.0]), (None, [0.0] * 6)],
                              "chunk_id long, embedding array<double>")
    asked = np.vstack([v[::97], rng.normal(size=(2, 6)) * 80])
    q = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(asked)] + [(90, None)], "qid long, q_vec array<double>")
    index = AN.build_lists(c, lists=lists)
    got = {}
    for r in AN.search_lists(index, q, k=8).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    for i, x in enumerate(asked):
        d = np.sqrt(((v - x) ** 2).sum(axis=1))
        assert got[i] == np.lexsort((np.arange(len(v)), d))[:8].tolist()
    assert set(got) == set(range(len(asked)))
    if lists:
        assert index.sizes.sum() == 600 and index.radii.max() < 60
    assert AN.ann_topk(c.limit(0), q).collect() == []


def test_running_sums_in_any_order(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{x}" if x % 11 else None, int(x), int(rng.integers(0, 9))) for x in rng.permutation(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long")
    got = {r.i: (r.before, r.place) for r in prefix_sums(df.withColumn("one", F.lit(1)), ["k", "i"], {"before": "n", "place": "one"}, partitions=7).collect()}
    total = 0
    for place, (k, i, n) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))):
        assert got[i] == (total, place)
        total += n
    assert prefix_sums(df.limit(0), ["k"], {"before": "n"}).collect() == []


def test_scorer_is_built_once_a_task_and_must_give_numbers(spark):
    pairs = spark.createDataFrame([("a b", "b c d"), ("a b", None), (None, None), ("a", "a")], "q string, t string").coalesce(1)
    got = [r.ce_score for r in SC.score_pairs(pairs, "q", "t", batch_size=2).collect()]
    assert got == pytest.approx([0.4, 0.0, 1.0, 1.0])

    def counting():
        calls = []
        return lambda q, t: (calls.append(len(q)), np.full(len(q), float(len(calls))))[1]

    assert [r.s for r in SC.score_pairs(pairs, "q", "t", counting, "s", batch_size=3).collect()] == [1.0, 1.0, 1.0, 2.0]
    hits = pairs.select(F.lit(1).alias("qid"), F.monotonically_increasing_id().alias("rank"), "q", "t")
    kept = R.compress(SC.score_pairs(hits, "q", "t", SC.order_scorer), F.col("ce_score"), top_k=2).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [0, 1]
    with pytest.raises(Exception, match="finite number"):
        SC.score_pairs(pairs, "q", "t", lambda: (lambda q, t: np.full(len(q), np.nan))).collect()


def test_generator_surface(spark):
    p = spark.createDataFrame([("Revenue fell\ndue to rain  today", "Why?"), ("", "Why?"), (None, None)], "context string, question string")
    p = p.select(G.build_prompt("context", "question").alias("prompt")).unionAll(spark.sql("select cast(null as string)"))
    got = [r.answer for r in G.answers(p, "prompt").collect()]
    assert got == ["Revenue fell due to rain today", "not found in context", "not found in context", ""]

    def shouting():
        return lambda prompts: [f"{len(prompts)} Answer: {x[-1]}" for x in prompts]

    df = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string").coalesce(1)
    assert [r.generated for r in G.generate(df, "prompt", shouting).collect()] == ["2 Answer: x", "2 Answer: x", "2 Answer: y"]
    assert [r.answer for r in G.answers(df, "prompt", shouting, unique=False).collect()] == ["x", "x", "y"]
    with pytest.raises(Exception, match="no text"):
        G.generate(df, "prompt", lambda: (lambda prompts: [])).collect()


def test_native_embedder(spark):
    df = spark.createDataFrame([("alpha beta beta",), ("",), (None,)], "t string")
    v = [r.v for r in df.select(hashed_embedding(TX.answer_tokens("t"), 16).alias("v")).collect()]
    assert sorted(x for x in v[0] if x) == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5]) or max(v[0]) == pytest.approx(1.0)
    assert v[1] == v[2] == [0.0] * 16


def test_sketches_merge_and_stream(spark, tmpdir_path):
    log = QS.request_log(spark, SF_SMALL).withColumnRenamed("event_type", "path")
    hours = RQ.window_sketches(log)
    days = RQ.sketch_stats(RQ.merge_windows(hours))
    whole = RQ.sketch_stats(RQ.window_sketches(log, every="1 day"))
    key = lambda r: (r.window_start, r.path)
    a, b = ({key(r): r for r in d.collect()} for d in (days, whole))
    assert a.keys() == b.keys() and all(a[k].n == b[k].n and a[k].max_ms == b[k].max_ms for k in a)
    values = {}
    for r in log.select("path", F.window("ts", "1 day")["start"].alias("w"), "latency_ms").collect():
        values.setdefault((r.w, r.path), []).append(r.latency_ms)
    for k, r in a.items():
        x = np.sort(values[k])
        assert (x < r.p50).mean() <= 0.53 and (x <= r.p50).mean() >= 0.47
    src = f"{tmpdir_path}/log"
    log.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(log.schema).parquet(src)
    q = (RQ.window_stats_stream(s, every="1 day", path="path").writeStream.format("memory").queryName("path_windows").outputMode("complete")
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.sql("select * from path_windows").collect()
    assert len(got) == len(b) and {r.path for r in got} == {k[1] for k in b} and all(r.p95 <= r.max_ms for r in got)


def test_selector_against_an_independent_solver(spark):
    """The fit equals Newton's method on the same class-balanced objective; stored weights score alike."""
    from annualis.operators import select as SL
    rng = np.random.default_rng(6)
    n, d = 240, len(SL.FEATURE_COLS)
    x = rng.normal(size=(n, d)).round(3)
    x[:, 0] = 1.0
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 1.5).astype(float)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    theta = np.zeros(d + 1)  # weights, intercept
    full = np.hstack([x, np.ones((n, 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ theta))
        grad = full.T @ (weight * (p - y)) + np.append(theta[:-1], 0)  # C = 1, the intercept is not penalised
        hess = (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag([1.0] * d + [1e-12])
        theta -= np.linalg.solve(hess, grad)
    rows = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                                 "i long, " + ", ".join(f"{c} double" for c in SL.FEATURE_COLS) + ", label int")
    model = SL.train_selector(rows, tol=1e-10)
    want = 1 / (1 + np.exp(-full @ theta))
    got = np.array([r.p for r in SL.score_candidates(model, rows).orderBy("i").collect()])
    assert np.abs(got - want).max() < 2e-3
    stored = np.array([r.p for r in SL.score_linear(rows, *SL.linear_weights(model)).orderBy("i").collect()])
    assert np.abs(stored - got).max() < 1e-9
    with pytest.raises(ValueError):
        SL.score_linear(rows, [1.0], 0.0)


def test_hashed_embedding_counts_buckets_for_few_and_many(spark):
    from hashlib import md5

    words = [f"w{i % 40}" for i in range(300)] + ["é", "1,2", ","]
    df = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>")
    for dim in (1, 16, 64, 127, 128, 300):
        counts = [0] * dim
        for x in words:
            counts[int(md5(x.encode()).hexdigest()[:4], 16) % dim] += 1
        norm = sum(n * n for n in counts) ** 0.5
        got = [r.v for r in df.select(hashed_embedding("w", dim).alias("v")).collect()]
        assert got == [[n / norm for n in counts], [0.0] * dim, [0.0] * dim]


def test_bm25_tasks_follow_the_scored_rows(spark, monkeypatch):
    from annualis.operators import lexical as LX

    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} gamma{i % 3}") for i in range(200)] + [(5, "alpha twice alpha")], "doc_id long, text string")
    qs = spark.createDataFrame([(0, "alpha beta1"), (1, "gamma2 alpha alpha"), (2, "none")], "qid long, question string")
    few = LX.bm25_topk(docs, qs, k=None)
    monkeypatch.setattr(LX, "TASK_ROWS", 20)
    many = LX.bm25_topk(docs, qs, k=None)
    tasks = max(int(s) for s in re.findall(r"hashpartitioning\(_d#\d+L?, (\d+)\)", many._jdf.queryExecution().toString()))
    assert tasks * 20 >= 402  # "alpha" alone stands in 201 documents and two questions
    rows = lambda df: {(r.qid, r.doc_id): round(r.score, 9) for r in df.collect()}
    assert rows(few) == rows(many) and len(rows(few)) == 400


def test_windows_leave_their_document_behind(spark):
    from annualis.operators.chunking import chunk_documents

    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    out = chunk_documents(df, size=10, overlap=3)
    generate = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert len(generate) == 1 and ", [1], false, [chunk_no" in generate[0]  # the second column, all tokens, ends here
    got = [r.text.split() for r in out.orderBy("chunk_no").collect()]
    assert [g[0] for g in got] == [f"w{i}" for i in range(0, 43, 7)] and [len(g) for g in got] == [10] * 6 + [8]
