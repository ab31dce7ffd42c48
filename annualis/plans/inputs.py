"""Inputs shared by the registered queries: how the given tables stand in for
chunks, question vectors and question tables (FIXTURES.md §2-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annualis.sources.tables import FILINGS_V_SQL, filings, questions, table

# vec_id < 20 are the question vectors of the embeddings table; the rest are chunk vectors.
QUESTION_VECTORS = 20


def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk vectors with their text: embeddings joined to documents on vec_id = doc_id; a vector
    without a document is a chunk with an empty text."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"]).filter(F.col("vec_id") >= QUESTION_VECTORS)
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return emb.join(docs, emb.vec_id == docs.doc_id, "left").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label", F.coalesce("text", F.lit("")).alias("text"))


def vector_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question vectors; every 4th question has no metadata filter (null = any label)."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding", "label"]).filter(F.col("vec_id") < QUESTION_VECTORS)
    return emb.select(
        F.col("vec_id").alias("qid"),
        F.col("embedding").alias("q_vec"),
        F.when(F.col("vec_id") % 4 == 0, F.lit(None)).otherwise(F.col("label")).cast("int").alias("f_label"),
    )


def filing_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk vectors with the company and year of their filing (null without one)."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding"]).filter(F.col("vec_id") >= QUESTION_VECTORS)
    fil = filings(spark, sf).select("doc_id", "company", "year")
    return emb.join(fil, emb.vec_id == fil.doc_id, "left").select(F.col("vec_id").alias("chunk_id"), "embedding", "company", "year")


def filing_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question vectors that ask for the company and year of a filing, for one of them, or for
    neither, and for 0 to 6 hits (0: the default)."""
    emb = table(spark, sf, "embeddings", ["vec_id", "embedding"]).filter(F.col("vec_id") < QUESTION_VECTORS)
    fil = filings(spark, sf).select("doc_id", "company", "year")
    return emb.join(fil, emb.vec_id == fil.doc_id, "left").select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("q_vec"),
        F.when(F.col("vec_id") % 3 != 1, F.col("company")).alias("f_company"),
        F.when(F.col("vec_id") % 4 < 2, F.col("year")).alias("f_year"),
        (F.col("vec_id") % 7).cast("int").alias("top_k"))


def filings_view(spark: SparkSession, sf: str) -> DataFrame:
    return filings(spark, sf)


def question_view(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, filings(spark, sf))


# ---- DuckDB text of the same inputs ----
VECTOR_CHUNKS_SQL = """chunks AS (
  SELECT e.vec_id AS chunk_id, e.embedding, e.label, coalesce(d.text, '') AS text
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id >= 20)"""

VECTOR_QUESTIONS_SQL = """qs AS (
  SELECT vec_id AS qid, embedding AS q_vec, CAST(CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label END AS INTEGER) AS f_label
  FROM embeddings WHERE vec_id < 20)"""

FILING_VECTORS_SQL = f"""{FILINGS_V_SQL},
chunks AS (
  SELECT e.vec_id AS chunk_id, e.embedding, f.company, f.year
  FROM embeddings e LEFT JOIN filings_v f ON f.doc_id = e.vec_id WHERE e.vec_id >= 20),
qs AS (
  SELECT e.vec_id AS qid, e.embedding AS q_vec, CASE WHEN vec_id % 3 <> 1 THEN company END AS f_company,
         CASE WHEN vec_id % 4 < 2 THEN year END AS f_year, CASE WHEN vec_id % 7 > 0 THEN vec_id % 7 ELSE 5 END AS top_k
  FROM embeddings e LEFT JOIN filings_v f ON f.doc_id = e.vec_id WHERE e.vec_id < 20)"""
