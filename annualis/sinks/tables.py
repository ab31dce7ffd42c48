"""Sinks (SNK-1..10): partitioned bundle / vector tables, catalog append of unseen keys,
delete-then-insert reload, eval-set and report JSON, selector artifact.

Writes go through ``DataFrameWriter``; reloads are expressed as anti-joins so they
are plain Spark jobs that can be retried after an executor loss."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annualis.operators.prefix import prefix_sums
from annualis.session import bounded_broadcast, path_exists

CATALOG_KEYS = ["doc_id", "company", "year"]
VECTOR_COLUMNS = ["company", "year", "chunk_id", "source_doc", "text", "embedding"]


def write_bundles(df: DataFrame, path: str) -> None:
    """SNK-1: one folder per (company, year); re-writing a pair replaces only that pair."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("company", "year").parquet(path))


def unseen_catalog_rows(new: DataFrame, existing: DataFrame, dedupe_batch: bool = False) -> DataFrame:
    """SNK-2 / JN-6: rows of ``new`` whose (doc_id, company, year) is not in ``existing``.
    Duplicates inside the batch are kept like the reference unless ``dedupe_batch``."""
    out = new.join(existing.select(*CATALOG_KEYS).distinct(), CATALOG_KEYS, "left_anti")
    return out.dropDuplicates(CATALOG_KEYS) if dedupe_batch else out


def append_catalog(new: DataFrame, path: str, existing: DataFrame | None) -> DataFrame:
    rows = new if existing is None else unseen_catalog_rows(new, existing)
    rows.write.mode("append").parquet(path)
    return rows


def chunks_out_path(out: str) -> str:
    """SNK-3: a ``.csv`` path is a file name, anything else a directory holding the chunks."""
    return out if out.endswith(".csv") else os.path.join(out, "sec_chunks")


def write_chunks(chunks: DataFrame, out: str) -> None:
    (chunks.select("chunk_id", "doc_id", "company", "year", "text")
     .write.mode("overwrite").option("header", "true").option("escape", '"').csv(chunks_out_path(out)))


def validate_vectors(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """SNK-4: split rows meeting the table contract (NOT NULL columns, vector of ``dim``)
    from the rejects."""
    ok = F.lit(True)
    for c in ["company", "year", "chunk_id", "source_doc", "text"]:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.col("embedding").isNull() | (F.size("embedding") == dim))
    return df.filter(ok), df.filter(~ok)


def with_surrogate_ids(df: DataFrame, order_col: str = "chunk_id", tie_cols: list[str] | None = None, first: int = 1) -> DataFrame:
    """SNK-4: dense surrogate ids ``first``, ``first`` + 1, ... in (``order_col``, ``tie_cols``) order,
    from running sums over range partitions (no single-partition window)."""
    ties = tie_cols or [c for c in df.columns if c != order_col]
    out = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), [order_col, *ties], {"_before": "_one"})
    return out.withColumn("id", F.col("_before") + first).drop("_one", "_before")


def _id_ranges(path: str) -> str:
    return path.rstrip("/") + "-ids"


def reserved_ids(spark: SparkSession, path: str) -> int:
    """The largest id that any append to the vector table at ``path`` has reserved; 0 if none."""
    ranges = _id_ranges(path)
    if not path_exists(spark, ranges):
        return 0
    return spark.read.schema("first long, last long").json(ranges).agg(F.max("last")).first()[0] or 0


def append_vectors(df: DataFrame, path: str, dim: int) -> DataFrame:
    """SNK-4 / SNK-5: append without de-duplication (a re-run doubles rows); returns rejects.

    Rows get ids that go on after those of earlier appends, in (chunk_id, company, year, source_doc,
    text) order.  The range is written beside the table before the rows are: an append that fails
    leaves a gap, never an id twice.  One append at a time.  The files of a (company, year) hold
    ascending ids and are split where a pair is large, so readers prune by folder and by id."""
    spark = df.sparkSession
    good, bad = validate_vectors(df.select(*VECTOR_COLUMNS), dim)
    before = reserved_ids(spark, path)
    ties = ["company", "year", "source_doc", "text"]
    # the running sums checkpoint their input, so counting it here does not compute the batch twice
    good = with_surrogate_ids(good, "chunk_id", ties, first=before + 1)
    n = good.count()
    if n:
        spark.createDataFrame([(before + 1, before + n)], "first long, last long").coalesce(1).write.mode("append").json(_id_ranges(path))
        good.select("id", *VECTOR_COLUMNS).repartitionByRange("company", "year", "id").sortWithinPartitions("company", "year", "id") \
            .write.mode("append").partitionBy("company", "year").parquet(path)
    return bad


def delete_then_insert(old: DataFrame, batch: DataFrame, mode: str = "cross") -> DataFrame:
    """SNK-6 / JN-7: drop every old row whose company is among the batch companies AND
    whose year is among the batch years (the cross product, wider than the batch pairs),
    then add the batch.  ``mode='pairs'`` drops only the exact (company, year) pairs."""
    if mode == "pairs":
        kept = old.join(batch.select("company", "year").distinct(), ["company", "year"], "left_anti")
    else:
        comps = batch.select("company").distinct().withColumn("_c", F.lit(1))
        years = batch.select("year").distinct().withColumn("_y", F.lit(1))
        marked = old.join(bounded_broadcast(comps), "company", "left").join(bounded_broadcast(years), "year", "left")
        kept = marked.filter(F.col("_c").isNull() | F.col("_y").isNull()).drop("_c", "_y")
    return kept.select(*old.columns).unionByName(batch.select(*old.columns))


def write_eval_set(items: DataFrame, path: str) -> None:
    """SNK-8."""
    items.write.mode("overwrite").json(path)


def write_report(summary: DataFrame, quality: DataFrame, items: DataFrame, path: str) -> None:
    """SNK-9: {summary, quality_success_only} as one JSON document under ``path``/summary and the
    items as JSON lines under ``path``/items, written by as many tasks as hold them."""
    spark = summary.sparkSession
    doc = spark.range(1).select(
        summary.select(F.struct("*")).scalar().alias("summary"),
        quality.select(F.struct("*")).scalar().alias("quality_success_only"),
    )
    doc.write.mode("overwrite").json(path.rstrip("/") + "/summary")
    items.write.mode("overwrite").json(path.rstrip("/") + "/items")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary document, items) of a written report."""
    return spark.read.json(path.rstrip("/") + "/summary"), spark.read.json(path.rstrip("/") + "/items")


def save_selector(model, path: str, feature_names: list[str]) -> None:
    """SNK-10: model + feature names, both written through Spark (works on shared storage)."""
    model.write().overwrite().save(path.rstrip("/") + "/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(feature_names,)], "feature_names array<string>").coalesce(1) \
        .write.mode("overwrite").json(path.rstrip("/") + "/feature_names")


def load_selector(spark, path: str):
    """Missing artifact -> (None, []): callers fall back to the heuristic select."""
    from pyspark.ml.classification import LogisticRegressionModel
    if not path_exists(spark, path.rstrip("/") + "/feature_names"):
        return None, []
    names = spark.read.json(path.rstrip("/") + "/feature_names").first()["feature_names"]
    return LogisticRegressionModel.load(path.rstrip("/") + "/model"), list(names)
