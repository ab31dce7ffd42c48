"""Given parquet tables and the derived views every engine computes the same way.

``filings_v`` turns the synthetic ``documents`` into filings: company = upper(source),
a year derived from the id, and one fixed cue sentence appended (the prose has none).
``q_v`` is the question table: every (company, year) x category, plus one row per
company and category without a year filter.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annualis import config as C
from annualis.session import parallelism

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Inputs smaller than this are never worth a redistribution shuffle.
SPREAD_MIN_BYTES = 1 << 20


def _row_groups(files: list[str]) -> int | None:
    """Row groups of local parquet files (footer reads only); None when unknown."""
    try:
        import pyarrow.parquet as pq
        total = 0
        for f in files:
            if not f.startswith("file:"):
                return None
            path = f[len("file:"):]
            if os.path.getsize(path) < SPREAD_MIN_BYTES:
                continue
            total += pq.ParquetFile(path).metadata.num_row_groups
        return total
    except Exception:  # noqa: BLE001 - any doubt: leave the scan as it is
        return None


def spread(df: DataFrame) -> DataFrame:
    """Scan parallelism follows parquet row groups: a large single-row-group file is one
    task however many cores there are.  When the input has fewer (large) row groups than
    the session's parallelism, round-robin the rows over that many partitions; large
    multi-file inputs are left alone (their scan is already parallel)."""
    spark = df.sparkSession
    target = parallelism(spark)
    try:
        files = df.inputFiles()
    except Exception:  # noqa: BLE001
        return df
    if not files or len(files) >= target:
        return df
    rg = _row_groups(files)
    if rg is None or rg == 0 or rg >= target:
        return df
    return df.repartition(target)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` right away keeps the ReadSchema pruned."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df = df.select(*columns) if columns else df
    return spread(df)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filings_v(doc_id, company, year, text)."""
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    cue_idx = (F.col("doc_id") % 20 + F.expr("doc_id div 80")) % len(C.CUE_SENTENCES)
    return d.select(
        "doc_id",
        F.upper("source").alias("company"),
        (F.lit(2020) + F.expr("(doc_id div 20) % 4")).cast("int").alias("year"),
        F.concat(F.col("text"), F.lit(". "), F.element_at(C.cue_sentences_col(), (cue_idx + 1).cast("int"))).alias("text"),
    )


def questions(spark: SparkSession, filings_df: DataFrame) -> DataFrame:
    """q_v(qid, category, company, year, question) from the (company, year) pairs that exist."""
    cats = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(v).alias("question")) for k, v in C.QUESTIONS.items()])
    pairs = filings_df.select("company", "year").distinct()
    no_year = filings_df.select("company").distinct().withColumn("year", F.lit(None).cast("int"))
    keys = pairs.unionByName(no_year)
    # the three fixed categories are generated per key (no join needed)
    return keys.select("company", "year", F.inline(cats)).select(
        F.concat_ws("|", "company", F.coalesce(F.col("year").cast("string"), F.lit("*")), "category").alias("qid"),
        "category",
        "company",
        "year",
        "question",
    )


# ---------------------------------------------------------------------------------
# The same derived views as DuckDB SQL (used by oracle_sql()).
# ---------------------------------------------------------------------------------


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CUES_SQL_LIST = "[" + ", ".join(_sql_str(s) for s in C.CUE_SENTENCES) + "]"

FILINGS_V_SQL = f"""filings_v AS (
  SELECT doc_id, upper(source) AS company, CAST(2020 + (doc_id // 20) % 4 AS INTEGER) AS year,
         text || '. ' || {CUES_SQL_LIST}[CAST((doc_id % 20 + doc_id // 80) % {len(C.CUE_SENTENCES)} AS INTEGER) + 1] AS text
  FROM documents)"""

QUESTIONS_SQL_VALUES = ", ".join(f"({_sql_str(k)}, {_sql_str(v)})" for k, v in C.QUESTIONS.items())

Q_V_SQL = f"""cats(category, question) AS (VALUES {QUESTIONS_SQL_VALUES}),
q_keys AS (
  SELECT DISTINCT company, year FROM filings_v
  UNION ALL SELECT DISTINCT company, CAST(NULL AS INTEGER) FROM filings_v),
q_v AS (
  SELECT company || '|' || coalesce(CAST(year AS VARCHAR), '*') || '|' || category AS qid,
         category, company, year, question
  FROM q_keys CROSS JOIN cats)"""
