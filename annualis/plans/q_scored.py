"""The scored path from a company's chunks to an answer: chunks and question vectors of our own,
hybrid retrieval under the question's company and year, pair-score rerank, category first, five
contexts, candidates with their scores, heuristic choice (SURVEY 3.2, 3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.functions.vectors import hashed_embedding, hashed_embedding_sql
from annualis.operators import chunking as CH
from annualis.operators import extract as EX
from annualis.operators import lexical as LX
from annualis.operators import rank as R
from annualis.operators import retrieve as RT
from annualis.operators import scoring as SC
from annualis.operators import select as SL
from annualis.plans.pipeline import TOP_CONTEXTS, category_match_sql
from annualis.plans.q_extract import candidates_sql
from annualis.plans.q_retrieval import bm25_sql
from annualis.plans.q_select import features_sql, select_sql
from annualis.plans.q_text import CHUNKS_SQL, answer_tokens_sql, token_f1_sql
from annualis.plans.registry import register
from annualis.session import cut_lineage, stored
from annualis.sources.tables import FILINGS_V_SQL, Q_V_SQL, filings, questions

#: Hits of each side of the hybrid search, and of the fused list that is scored.
DENSE_POOL, LEXICAL_POOL, RERANK_POOL = 50, 50, 40


def filing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id "doc-position", company, year, text, words, embedding) of every filing, stored: both
    sides of the search, the filters and the hits read their columns of it."""
    c = CH.chunk_documents(filings(spark, sf), keep=["company", "year"])
    c = c.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
                 "company", "year", "text", TX.answer_tokens("text").alias("words"))
    return stored(c.withColumn("embedding", hashed_embedding("words")), "chunks")


def scored_hits(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, category, question, chunk_id, in_rank, ce_score, text) of every question's hybrid hits.

    Questions of a category share their text, so BM25 scores a chunk once per category and the
    company and year decide which questions see it; the dense side filters before the search."""
    chunks = filing_chunks(spark, sf)
    q = questions(spark, filings(spark, sf))
    vectors = q.withColumn("q_vec", hashed_embedding(TX.answer_tokens("question")))
    dense = RT.knn_prefilter(chunks, vectors, [("company", "company"), ("year", "year")], k=DENSE_POOL)
    scores = LX.bm25_topk(chunks, C.questions_df(spark), k=None, doc_key="chunk_id", q_key="category", q_text="question", doc_tokens="words")
    seen = scores.join(chunks.select("chunk_id", "company", F.col("year").alias("_y")), "chunk_id")
    seen = seen.join(q.select("qid", "category", "company", "year"), ["category", "company"]) \
        .where(F.col("year").isNull() | (F.col("year") == F.col("_y")))
    w = Window.partitionBy("qid").orderBy(F.round("score", 6).desc(), "chunk_id")
    lexical = seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LEXICAL_POOL).select("qid", "chunk_id", "score")
    fused = LX.hybrid_fuse(dense, lexical, alpha=0.85, top_k=RERANK_POOL)
    hits = fused.select("qid", "chunk_id", F.col("rank").alias("in_rank")) \
        .join(q.select("qid", "category", "question"), "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    words = lambda c: F.array_join(TX.answer_tokens(c), " ")
    hits = SC.score_pairs(hits.withColumns({"_q": words("question"), "_t": words("text")}), "_q", "_t")
    return hits.withColumn("ce_score", F.round("ce_score", 6)).drop("_q", "_t")


def scored_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The five contexts of every question: by score, those of its category first."""
    ranked = R.rerank(scored_hits(spark, sf), F.col("ce_score"), in_rank="in_rank", top_k=RERANK_POOL)
    top = R.priority_top(ranked, "qid", EX.category_match(F.col("text"), F.col("category")), "rr_rank", ["chunk_id"], n=TOP_CONTEXTS)
    return cut_lineage(top.withColumn("ctx_rank", (F.col("prio_rank") - 1).cast("int")))  # read twice by the answers


def scored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ctx = scored_contexts(spark, sf).select("qid", "category", "chunk_id", "ctx_rank", "ce_score", "text")
    return EX.extract_candidates(ctx, ce_col="ce_score", keep=["chunk_id"])


SCORED_SQL = f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
{CHUNKS_SQL.replace("FROM documents)", "FROM filings_v)", 1)},
ck AS MATERIALIZED (SELECT c.doc_id || '-' || c.chunk_no AS chunk_id, f.company, f.year, c.text FROM chunks c JOIN filings_v f USING (doc_id)),
ct AS MATERIALIZED (SELECT *, {answer_tokens_sql('text')} AS words FROM ck),
cv AS MATERIALIZED (SELECT *, {hashed_embedding_sql('words')} AS embedding FROM ct),
qw AS (SELECT *, {answer_tokens_sql('question')} AS words FROM q_v),
qvec AS MATERIALIZED (SELECT *, {hashed_embedding_sql('words')} AS q_vec FROM qw),
ds AS MATERIALIZED (SELECT q.qid, c.chunk_id, list_distance(c.embedding, q.q_vec) AS dist FROM cv c JOIN qvec q
  ON q.company = c.company AND (q.year IS NULL OR q.year = c.year)),
dense AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, chunk_id) AS rn FROM ds) WHERE rn <= {DENSE_POOL}),
{bm25_sql('ck', 'chunk_id', 'text', 'cats', 'category', 'question', None, prefix='z')},
ls AS (SELECT q.qid, z.chunk_id, z.score FROM z_sc z JOIN ck USING (chunk_id) JOIN q_v q ON q.category = z.qid AND q.company = ck.company
  AND (q.year IS NULL OR q.year = ck.year)),
lex AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rn FROM ls) WHERE rn <= {LEXICAL_POOL}),
dn AS (SELECT qid, chunk_id, CASE WHEN max(dist) OVER w = min(dist) OVER w THEN 1.0
  ELSE (max(dist) OVER w - dist) / (max(dist) OVER w - min(dist) OVER w) END AS dense_n FROM dense WINDOW w AS (PARTITION BY qid)),
bn AS (SELECT qid, chunk_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS bm25_n FROM lex WINDOW w AS (PARTITION BY qid)),
fused AS (SELECT coalesce(dn.qid, bn.qid) AS qid, coalesce(dn.chunk_id, bn.chunk_id) AS chunk_id,
  0.85 * coalesce(dense_n, 0.0) + 0.15 * coalesce(bm25_n, 0.0) AS score
  FROM dn FULL OUTER JOIN bn ON dn.qid = bn.qid AND dn.chunk_id = bn.chunk_id),
fr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS in_rank FROM fused)
  WHERE in_rank <= {RERANK_POOL}),
sc AS MATERIALIZED (SELECT fr.qid, q.category, fr.chunk_id, fr.in_rank, ck.text, round({token_f1_sql('ck.text', 'q.question')}, 6) AS ce
  FROM fr JOIN q_v q USING (qid) JOIN ck ON ck.chunk_id = fr.chunk_id),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce DESC, in_rank) AS rr_rank FROM sc),
ctx AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {category_match_sql('text', 'category')} DESC, rr_rank) - 1
  AS INTEGER) AS ctx_rank FROM rr) WHERE ctx_rank < {TOP_CONTEXTS})"""

SCORED_CANDS_SQL = f"""{SCORED_SQL},
{candidates_sql('ctx', 'qid, chunk_id, ce', 'category').replace('0.0 AS ce_score', 'ce AS ce_score').replace('sents AS (', 'sents AS MATERIALIZED (', 1)}"""


@register("scored_contexts", f"""{SCORED_SQL}
SELECT qid, chunk_id, ctx_rank, ce AS ce_score FROM ctx""")
def scored_contexts_query(spark, sf):
    """JN-4 -> WIN-1 -> WIN-6: five contexts per question from hybrid hits, reranked by a batched pair scorer."""
    return scored_contexts(spark, sf).select("qid", "chunk_id", "ctx_rank", "ce_score")


@register("scored_features", f"""{SCORED_CANDS_SQL}
{features_sql('cands').replace('SELECT qid,', 'SELECT qid, chunk_id,', 1)}""")
def scored_features(spark, sf):
    """SEL-1: selector features of the candidates of the scored path, with their pair scores."""
    f = SL.features(scored_candidates(spark, sf))
    names = {n: ("ctx_rank_f" if n == "ctx_rank" else n) for n in C.FEATURE_NAMES}
    return f.select("qid", "chunk_id", "ctx_rank", "sent_pos", "patt_pos",
                    *[F.round(F.col(SL.FEATURE_PREFIX + n), 6).alias(names[n]) for n in C.FEATURE_NAMES])


@register("scored_answers", f"""{SCORED_CANDS_SQL},
{select_sql('cands')},
best AS (SELECT qid, arg_min(text, ctx_rank) AS text, arg_min(chunk_id, ctx_rank) AS chunk_id FROM ctx GROUP BY qid)
SELECT q.qid, coalesce(p.phrase, substring(b.text, 1, 300), '') AS answer, coalesce(p.chunk_id, b.chunk_id) AS chunk_id,
       CAST(p.phrase IS NOT NULL AS INTEGER) AS extracted, coalesce(p.ce_score, 0.0) AS ce_score
FROM q_v q LEFT JOIN (SELECT * FROM pick WHERE rn = 1) p USING (qid) LEFT JOIN best b ON b.qid = q.qid""")
def scored_answers(spark, sf):
    """From chunk to answer: the heuristic choice (SEL-2) among the scored candidates of each
    question, else the beginning of its first context."""
    ctx = scored_contexts(spark, sf)
    pick = SL.select_heuristic(EX.extract_candidates(
        ctx.select("qid", "category", "chunk_id", "ctx_rank", "ce_score", "text"), ce_col="ce_score", keep=["chunk_id"]))
    best = ctx.where("ctx_rank = 0").select("qid", F.col("text").alias("_text"), F.col("chunk_id").alias("_chunk"))
    q = questions(spark, filings(spark, sf)).select("qid")
    out = q.join(pick.select("qid", "phrase", "chunk_id", "ce_score"), "qid", "left").join(best, "qid", "left")
    return out.select("qid", F.coalesce("phrase", F.substring("_text", 1, 300), F.lit("")).alias("answer"),
                      F.coalesce("chunk_id", "_chunk").alias("chunk_id"), F.col("phrase").isNotNull().cast("int").alias("extracted"),
                      F.coalesce("ce_score", F.lit(0.0)).alias("ce_score"))
