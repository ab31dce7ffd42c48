"""Incremental ingest ledger (STR-1).

A stamp per (company, year) makes ingest idempotent: a key is stamped once files for it
exist; ``rebuild`` clears stamps so the next batch re-stamps them.  The stream reads
landed filing rows (a file source with a checkpoint), and each micro-batch appends only
the keys that are not stamped yet (anti-join against the ledger table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.session import path_exists

LEDGER_SCHEMA = "company string, year int, files long, stamped_batch long"


def new_stamps(batch: DataFrame, ledger: DataFrame, batch_id: int) -> DataFrame:
    """Keys of this batch with at least one file and no stamp yet."""
    counts = (batch.select(TX.company_key("company", drop_spaces=True).alias("company"), F.col("year").cast("int"))
              .groupBy("company", "year").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > 0))
    return (counts.join(ledger.select("company", "year"), ["company", "year"], "left_anti")
            .withColumn("stamped_batch", F.lit(batch_id).cast("long")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stamps written so far; empty only if the ledger does not exist yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def rebuild(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Clear the stamps of ``keys`` (company, year); files on disk are left alone."""
    return ledger.join(keys.select("company", "year"), ["company", "year"], "left_anti")


def start_ledger_stream(spark: SparkSession, source: DataFrame, ledger_path: str, checkpoint: str,
                        available_now: bool = True):
    """Run the ledger over a streaming source of (company, year, ...) rows."""
    def each(batch: DataFrame, batch_id: int) -> None:
        stamps = new_stamps(batch, read_ledger(spark, ledger_path), batch_id)
        stamps.write.mode("append").parquet(ledger_path)

    w = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
