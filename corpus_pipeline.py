"""The document pipeline: each stage reads what the one before has written.

``STAGES`` lists (name, function of (spark, docs, sf_dir) -> DataFrame); all but the last
return the columns of ``documents``.  ``run`` applies them to ``documents``: a stage's result
is written as Parquet into the shared checkpoint folder and read again as the next one's
input, so a lost executor costs at most one stage.

A stage keeps null and repeated rows like any others unless it says otherwise; empty tables
pass through; extra columns stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annualis.llm import op02_factorization_toxicity as toxicity
from annualis.llm import op04_ftrl_language as language
from annualis.llm.common import written
from annualis.llm.op05_cgk_decontaminate import without_leaks
from annualis.llm.op08_probminhash import near_duplicates
from annualis.llm.op10_ac_viterbi import encode_documents

#: SQL cannot express the trained models; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; empty texts stay."""
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the others; texts without a letter go."""
    return language.in_known_language(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Of rows that repeat an id one stays (the one with the largest text); rows without an id
    belong to no class and stay."""
    kept = near_duplicates(docs).where("kept").select("doc_id")
    here = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    nth = "_" * max(map(len, docs.columns)) + "nth"  # longer than any column, so none is named so
    one = here.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last())))
    return one.where(F.col(nth) == 1).drop(nth).unionAll(docs.where(F.col("doc_id").isNull()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage within a small edit distance of a benchmark item."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_byte_tokens, round_trip of each document."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("tokenise", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that every stage has kept."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
