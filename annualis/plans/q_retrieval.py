"""Registered retrieval queries: kNN pre/post-filter, packing, local answer, BM25, hybrid, ANN."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.functions.vectors import hashed_embedding, hashed_embedding_sql
from annualis.operators import rank as R
from annualis.operators import retrieve as RT
from annualis.plans.inputs import (FILING_VECTORS_SQL, VECTOR_CHUNKS_SQL, VECTOR_QUESTIONS_SQL, filing_questions,
                                   filing_vectors, vector_chunks, vector_questions)
from annualis.plans.registry import register

_SCORED_SQL = f"""WITH {VECTOR_CHUNKS_SQL},
{VECTOR_QUESTIONS_SQL}"""


def _knn(spark, sf, k=5, keep=None):
    return RT.knn_prefilter(vector_chunks(spark, sf), vector_questions(spark, sf), [("f_label", "label")], k=k,
                            keep=keep or [])


@register("knn_prefilter", f"""{_SCORED_SQL},
scored AS (
  SELECT q.qid, c.chunk_id, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist
  FROM chunks c JOIN qs q ON q.f_label IS NULL OR q.f_label = c.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored)
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= 5""")
def knn_prefilter(spark, sf):
    """JN-1 + FLT-1: nearest 5 chunks per question vector among chunks with its label."""
    return _knn(spark, sf).select("qid", "chunk_id", F.round("dist", 6).alias("dist"), "rank")


@register("knn_postfilter_fallback", f"""{_SCORED_SQL},
scored AS (
  SELECT q.qid, q.f_label, c.chunk_id, c.label,
         list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist
  FROM chunks c CROSS JOIN qs q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored),
top AS (SELECT *, (coalesce(f_label, 0) = 0 OR label = f_label) AS m FROM ranked WHERE rn <= 5),
flag AS (SELECT *, max(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anym FROM top)
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn - 1 AS INTEGER) AS rank
FROM flag WHERE m OR (anym = 0 AND coalesce(f_label, 0) <> 0)""")
def knn_postfilter_fallback(spark, sf):
    """JN-2: nearest 5 over all chunks, then the label filter, falling back to the unfiltered 5."""
    out = RT.knn_postfilter(vector_chunks(spark, sf), vector_questions(spark, sf), [("f_label", "label")], k=5)
    return out.select("qid", "chunk_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


_FILING_SCORED_SQL = """scored AS (
  SELECT q.*, c.chunk_id, c.company, c.year, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist
  FROM chunks c JOIN qs q ON {on}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored)"""


@register("knn_company_year", f"""WITH {FILING_VECTORS_SQL},
{_FILING_SCORED_SQL.format(on="(f_company IS NULL OR f_company = company) AND (f_year IS NULL OR f_year = year)")}
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= top_k""")
def knn_company_year(spark, sf):
    """JN-1 + FLT-1: nearest chunks of the company and year a question asks for (both, one or
    neither), as many as it asks for."""
    out = RT.knn_prefilter(filing_vectors(spark, sf), filing_questions(spark, sf),
                           [("f_company", "company"), ("f_year", "year")], q_top_k="top_k")
    return out.select("qid", "chunk_id", F.round("dist", 6).alias("dist"), "rank")


@register("knn_literal", f"""{_SCORED_SQL},
scored AS (
  SELECT q.qid, c.chunk_id, list_distance(CAST(c.embedding AS DOUBLE[]),
    list_transform(q.q_vec, lambda x: CAST(printf('%.3f', CAST(x AS DOUBLE)) AS DOUBLE))) AS dist
  FROM chunks c JOIN qs q ON q.f_label IS NULL OR q.f_label = c.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored)
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= 5""")
def knn_literal(spark, sf):
    """TXT-9 + JN-1: the search with question vectors as their text literals give them, here to 3 decimals."""
    out = RT.knn_prefilter(vector_chunks(spark, sf), vector_questions(spark, sf), [("f_label", "label")], q_decimals=3)
    return out.select("qid", "chunk_id", F.round("dist", 6).alias("dist"), "rank")


@register("knn_postfilter_company_year", f"""WITH {FILING_VECTORS_SQL},
{_FILING_SCORED_SQL.format(on="true")},
top AS (SELECT *, (f_company IS NULL OR coalesce(company = f_company, false)) AND (f_year IS NULL OR coalesce(year = f_year, false)) AS m
        FROM ranked WHERE rn <= top_k),
flag AS (SELECT *, max(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anym FROM top)
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn - 1 AS INTEGER) AS rank
FROM flag WHERE m OR (anym = 0 AND (f_company IS NOT NULL OR f_year IS NOT NULL))""")
def knn_postfilter_company_year(spark, sf):
    """JN-2: as many nearest chunks as each question asks for, then its company and year, falling
    back to the unfiltered hits."""
    out = RT.knn_postfilter(filing_vectors(spark, sf), filing_questions(spark, sf),
                            [("f_company", "company"), ("f_year", "year")], q_top_k="top_k")
    return out.select("qid", "chunk_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


_PACK_SQL = f"""{_SCORED_SQL},
scored AS (
  SELECT q.qid, c.chunk_id, c.text, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist
  FROM chunks c JOIN qs q ON q.f_label IS NULL OR q.f_label = c.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored),
kept5 AS (SELECT * FROM ranked WHERE rn <= 5),
packed AS (
  SELECT *, CAST(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY qid ORDER BY rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used_chars
  FROM kept5)"""


@register("pack_chars", f"""{_PACK_SQL}
SELECT qid, CAST(rn AS INTEGER) AS rank, chunk_id, used_chars FROM packed WHERE used_chars <= 6000""")
def pack_chars(spark, sf):
    """WIN-3 + WIN-4: first 5 hits, packed into 6000 characters (prefix, stop at first overflow)."""
    hits = R.keep_first(_knn(spark, sf, keep=["text"]), 5)
    return R.pack_chars(hits).select("qid", "rank", "chunk_id", "used_chars")


@register("local_answer", f"""{_PACK_SQL},
kept AS (SELECT * FROM packed WHERE used_chars <= 6000),
agg AS (SELECT qid, arg_min(text, rn) AS first_context, count(*) AS n_contexts,
               string_agg(text, chr(10) || chr(10) ORDER BY rn) AS context FROM kept GROUP BY qid)
SELECT qs.qid, coalesce(agg.first_context, 'I couldn''t find relevant context locally.') AS answer,
       CAST(coalesce(agg.n_contexts, 0) AS BIGINT) AS n_contexts,
       CAST(length(coalesce(agg.context, '')) AS INTEGER) AS context_chars
FROM qs LEFT JOIN agg ON agg.qid = qs.qid""")
def local_answer(spark, sf):
    """Flagship slice: kNN -> keep 5 -> pack 6000 chars -> first context as the answer."""
    qs = vector_questions(spark, sf).select("qid")
    kept = R.pack_chars(R.keep_first(_knn(spark, sf, keep=["text"]), 5))
    ans = R.local_answer(qs, kept)
    return ans.select("qid", "answer", "n_contexts", F.length("context").alias("context_chars"))


# ---------------------------------------------------------------- lexical and hybrid
from annualis.operators import lexical as LX  # noqa: E402
from annualis.plans.q_text import answer_tokens_sql  # noqa: E402
from annualis.sources.tables import table  # noqa: E402


def bm25_sql(corpus: str, key: str, text: str, qsrc: str, qkey: str, qtext: str, k: int | None, prefix: str = "b") -> str:
    """DuckDB CTEs for BM25: ``{prefix}_sc`` has (qid, {key}, score); the last CTE ``{prefix}_top``
    the first k with rn (none if k is)."""
    p = prefix
    top = "" if k is None else f""",
{p}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, {key}) AS rn FROM {p}_sc)
  WHERE rn <= {k})"""
    return f"""{p}_dt AS (SELECT {key} AS d, {answer_tokens_sql(text)} AS t FROM {corpus}),
{p}_stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}_dt),
{p}_dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM {p}_dt) GROUP BY term),
{p}_idf0 AS (SELECT term, ln(((SELECT n FROM {p}_stats) - df + 0.5) / (df + 0.5)) AS idf FROM {p}_dfs),
{p}_idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM {p}_idf0) ELSE idf END AS idf FROM {p}_idf0),
{p}_qt AS (SELECT q AS qid, term, count(*) AS qtf FROM
  (SELECT {qkey} AS q, unnest({answer_tokens_sql(qtext)}) AS term FROM {qsrc}) GROUP BY 1, 2),
{p}_post AS (SELECT d, dl, term, count(*) AS tf FROM
  (SELECT d, len(t) AS dl, unnest(t) AS term FROM {p}_dt) WHERE term IN (SELECT term FROM {p}_qt) GROUP BY d, dl, term),
{p}_sc AS (SELECT qt.qid, po.d AS {key},
  sum(qt.qtf * i.idf * po.tf * 2.5 / (po.tf + 1.5 * (1 - 0.75 + 0.75 * po.dl / (SELECT avgdl FROM {p}_stats)))) AS score
  FROM {p}_post po JOIN {p}_qt qt USING (term) JOIN {p}_idf i USING (term) GROUP BY 1, 2){top}"""


@register("bm25_topk", f"""WITH {bm25_sql('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text', 5)}
SELECT qid, doc_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM b_top""")
def bm25_topk(spark, sf):
    """JN-3: BM25 (k1 1.5, b 0.75, idf floor 0.25 x mean) of every benchmark item over all documents."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    qs = table(spark, sf, "benchmark", ["item_id", "text"]).select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    out = LX.bm25_topk(docs, qs, k=5)
    return out.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


HYBRID_POOL = 400


def _hybrid_questions(spark, sf):
    """Vector questions with a text: question i carries benchmark item i."""
    bench = table(spark, sf, "benchmark", ["item_id", "text"])
    vq = vector_questions(spark, sf)
    return vq.join(bench, vq.qid == bench.item_id, "left").select("qid", "q_vec", "f_label", F.col("text").alias("question"))


@register("hybrid_topk", f"""{_SCORED_SQL},
hq AS (SELECT qs.qid, b.text AS question FROM qs LEFT JOIN benchmark b ON b.item_id = qs.qid),
{bm25_sql('chunks', 'chunk_id', 'text', 'hq', 'qid', 'question', HYBRID_POOL)},
scored AS (
  SELECT q.qid, c.chunk_id, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist
  FROM chunks c JOIN qs q ON q.f_label IS NULL OR q.f_label = c.label),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored)
  WHERE rn <= {HYBRID_POOL}),
dn AS (SELECT qid, chunk_id, CASE WHEN max(dist) OVER w = min(dist) OVER w THEN 1.0
  ELSE (max(dist) OVER w - dist) / (max(dist) OVER w - min(dist) OVER w) END AS dense_n FROM dense WINDOW w AS (PARTITION BY qid)),
bn AS (SELECT qid, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bm25_n FROM b_top WINDOW w AS (PARTITION BY qid)),
fused AS (SELECT coalesce(dn.qid, bn.qid) AS qid, coalesce(dn.chunk_id, bn.chunk_id) AS chunk_id,
  coalesce(dense_n, 0.0) AS dense_n, coalesce(bm25_n, 0.0) AS bm25_n
  FROM dn FULL OUTER JOIN bn ON dn.qid = bn.qid AND dn.chunk_id = bn.chunk_id),
fr AS (SELECT *, 0.85 * dense_n + 0.15 * bm25_n AS score,
  row_number() OVER (PARTITION BY qid ORDER BY round(0.85 * dense_n + 0.15 * bm25_n, 6) DESC, chunk_id) AS rn FROM fused)
SELECT qid, chunk_id, round(dense_n, 6) AS dense_n, round(bm25_n, 6) AS bm25_n, round(score, 6) AS score,
  CAST(rn AS INTEGER) AS rank FROM fr WHERE rn <= 5""")
def hybrid_topk(spark, sf):
    """JN-4: dense pool (filtered kNN) + BM25 pool of 400 each, min-max fused with alpha 0.85, top 5."""
    chunks = vector_chunks(spark, sf)
    qs = _hybrid_questions(spark, sf)
    dense = RT.knn_prefilter(chunks, qs, [("f_label", "label")], k=HYBRID_POOL)
    lex = LX.bm25_topk(chunks, qs, k=HYBRID_POOL, doc_key="chunk_id", q_key="qid", q_text="question")
    out = LX.hybrid_fuse(dense, lex, alpha=0.85, top_k=5)
    return out.select("qid", "chunk_id", F.round("dense_n", 6).alias("dense_n"), F.round("bm25_n", 6).alias("bm25_n"),
                      F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- ANN, embedder, rerank, prompts
from annualis.operators import ann as AN  # noqa: E402


@register("ann_topk", f"""{_SCORED_SQL},
scored AS (
  SELECT q.qid, c.chunk_id, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.q_vec AS DOUBLE[])) AS dist FROM chunks c CROSS JOIN qs q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM scored)
SELECT qid, chunk_id, round(dist, 6) AS dist, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= 5""")
def ann_topk(spark, sf):
    """JN-5: nearest 5 chunks over k-means lists, probed until the triangle inequality excludes the rest."""
    out = AN.ann_topk(vector_chunks(spark, sf).select("chunk_id", "embedding"), vector_questions(spark, sf).select("qid", "q_vec"), k=5)
    return out.select("qid", "chunk_id", F.round("dist", 6).alias("dist"), "rank")


@register("ann_recall", f"""WITH {VECTOR_QUESTIONS_SQL} SELECT qid, CAST(1.0 AS DOUBLE) AS recall_at_5 FROM qs""")
def ann_recall(spark, sf):
    """JN-5: recall@5 per question of the list search against exact kNN over many small lists: 1 by its bound."""
    chunks = vector_chunks(spark, sf).select("chunk_id", "embedding")
    qs = vector_questions(spark, sf).select("qid", "q_vec")
    found = AN.ann_topk(chunks, qs, k=5, lists=16).select("qid", "chunk_id")
    exact = RT.knn_prefilter(chunks, qs, [], k=5).select("qid", "chunk_id")
    found = exact.join(found.withColumn("_f", F.lit(1)), ["qid", "chunk_id"], "left")
    return found.groupBy("qid").agg((F.sum(F.coalesce("_f", F.lit(0))) / F.count(F.lit(1))).alias("recall_at_5"))


@register("embed_hashed")
def embed_hashed(spark, sf):
    """TXT-8: default hashed bag-of-words embedder (Arrow-batched pandas UDF) over every
    document; returns dimension and norm (1 for non-empty text)."""
    d = table(spark, sf, "documents", ["doc_id", "text"])
    e = AN.embed_column(d, "text", dim=64)
    from annualis.functions.vectors import l2_norm
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(l2_norm("embedding"), 4).alias("norm"))


@register("embed_chunks", f"""WITH t AS (SELECT doc_id, {answer_tokens_sql('text')} AS words FROM documents),
e AS (SELECT doc_id, {hashed_embedding_sql('words')} AS v FROM t)
SELECT doc_id, list_transform(v, lambda x: round(x, 6)) AS embedding FROM e""")
def embed_chunks(spark, sf):
    """TXT-8: the native embedder (word counts per md5 bucket, length one) over every document."""
    d = table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.transform(hashed_embedding(TX.answer_tokens("text")), lambda x: F.round(x, 6)).alias("embedding"))
