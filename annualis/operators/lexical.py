"""BM25 ranking (JN-3) and dense + BM25 hybrid fusion (JN-4).

BM25 at scale: document frequencies come from one pass over ``array_distinct`` of each
document's tokens (stored once), aggregated map-side by term and checkpointed; postings are built only for the
terms that occur in the (bounded, broadcast) question vocabulary, so a corpus never shuffles
its full token stream and nothing stays cached.  A hot term (one that appears in a third of all documents) is
handled by the broadcast join and the partial aggregations: no task holds a term's
whole posting list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.session import cut_lineage, parallelism, stored

MAX_QUERY_TERMS = 1_000_000
#: Scored (question, term, document) rows of a task, about.
TASK_ROWS = 500_000


def bm25_topk(docs: DataFrame, questions: DataFrame, k: int | None = 5, doc_key: str = "doc_id", doc_text: str = "text",
              q_key: str = "qid", q_text: str = "question", k1: float = 1.5, b: float = 0.75, eps: float = 0.25,
              tokenizer=TX.answer_tokens, doc_tokens: str | None = None) -> DataFrame:
    """Okapi BM25 top-k documents per question: (q_key, doc_key, score, rank).

    idf = ln((N - df + 0.5) / (df + 0.5)); a negative idf is replaced by eps * mean idf
    over the corpus vocabulary.  Query terms count with their multiplicity.  Only
    documents sharing at least one term with the question are ranked.  ``k=None`` gives
    the scores of all of them without a rank.  ``doc_tokens`` names a column that holds the
    documents' tokens already.
    """
    # The documents are cut into tokens once.  One pass over these gives the number of documents and
    # their length (the row without a term) and the document frequency of every term; a second one,
    # over the question's terms only, the postings.
    if doc_tokens is None:
        tok = stored(docs.select(F.col(doc_key).alias("_d"), tokenizer(doc_text).alias("_t")), "tokens")
    else:
        tok = docs.select(F.col(doc_key).alias("_d"), F.col(doc_tokens).alias("_t"))
    held = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_t"))
    stats = cut_lineage(tok.select(F.size("_t").alias("dl"), F.explode(held).alias("term"))
                        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl")))
    whole = stats.where("term is null")
    n_docs, avgdl = whole.select("df").scalar(), whole.select(F.col("dl") / F.col("df")).scalar()
    dfs = stats.where("term is not null")
    raw_idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean_idf = dfs.select(F.avg(raw_idf)).scalar()
    idf = dfs.select("term", F.when(raw_idf < 0, eps * mean_idf).otherwise(raw_idf).alias("idf"))

    qterms = (questions.select(F.col(q_key).alias("_q"), F.explode(tokenizer(q_text)).alias("term"))
              .groupBy("_q", "term").agg(F.count(F.lit(1)).alias("qtf")))
    # the question side bounds both broadcasts: q_idf has at most one row per question term
    small = qterms.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS
    vocab = qterms.select("term").distinct()
    vocab = F.broadcast(vocab) if small else vocab
    q_idf = qterms.join(idf.join(vocab, "term", "left_semi"), "term", "inner")
    q_idf = F.broadcast(q_idf) if small else q_idf

    # a document is scored in one task: its postings are dealt by its key, over as many tasks as the
    # document frequencies say that there will be scored rows
    scored = dfs.join(qterms, "term").agg(F.sum("df")).first()[0] or 0
    tasks = max(parallelism(docs.sparkSession), -(-scored // TASK_ROWS))
    postings = (tok.select("_d", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
                .join(vocab, "term", "left_semi").repartition(tasks, "_d")
                .groupBy("_d", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    contrib = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scores = postings.join(q_idf, "term", "inner").groupBy("_q", "_d").agg(F.sum(contrib).alias("score"))
    if k is None:
        return scores.select(F.col("_q").alias(q_key), F.col("_d").alias(doc_key), "score")
    # order on the score rounded to 1e-6 so copies of a document tie exactly whatever the
    # summation order, then on the key
    w = Window.partitionBy("_q").orderBy(F.round("score", 6).desc(), F.col("_d"))
    top = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("_q").alias(q_key), F.col("_d").alias(doc_key), "score", "rank")


def minmax(col: str, part: str, invert: bool = False):
    """Per-question min-max normalisation to [0, 1]; all-equal scores map to 1."""
    w = Window.partitionBy(part)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    x = (hi - F.col(col)) if invert else (F.col(col) - lo)
    return F.when(hi == lo, F.lit(1.0)).otherwise(x / (hi - lo))


def hybrid_fuse(dense: DataFrame, lexical: DataFrame, alpha: float = 0.85, top_k: int = 5, q_key: str = "qid",
                key: str = "chunk_id", dense_col: str = "dist", lex_col: str = "score",
                dense_is_distance: bool = True, alpha_on: str = "dense") -> DataFrame:
    """Full outer join of the two candidate pools on (question, chunk); each score is
    min-max normalised within its pool (a missing side counts 0), fused as
    ``alpha * dense + (1 - alpha) * bm25`` (or the reverse with ``alpha_on='bm25'``)."""
    d = dense.select(q_key, key, minmax(dense_col, q_key, invert=dense_is_distance).alias("dense_n"))
    x = lexical.select(q_key, key, minmax(lex_col, q_key).alias("bm25_n"))
    a = alpha if alpha_on == "dense" else 1 - alpha
    fused = (d.join(x, [q_key, key], "full_outer")
             .select(q_key, key, F.coalesce("dense_n", F.lit(0.0)).alias("dense_n"),
                     F.coalesce("bm25_n", F.lit(0.0)).alias("bm25_n")))
    fused = fused.withColumn("score", a * F.col("dense_n") + (1 - a) * F.col("bm25_n"))
    w = Window.partitionBy(q_key).orderBy(F.round("score", 6).desc(), F.col(key))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
