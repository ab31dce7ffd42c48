"""Records of large text files that one line-oriented scan can not cut: quoted CSV with line breaks
inside values, and JSON arrays of objects.

A file is read in byte ranges by many tasks.  A task sees pieces (CSV: lines; JSON: what ends in a
closing brace) without knowing what stands before its range, but what it needs is a sum: the
number of quotes, which tells inside from outside by its parity, and for JSON the depth of
brackets.  Each range's total is worked out for both parities, one small row per range is
summed up over the file, and every piece then knows its place.  The pieces of a record meet by
its number, so a record may lie across ranges, and a file of any size is read by as many tasks
as it has ranges."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = ["file", "range"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, range, seq, v): pieces in file order by (range, seq)."""
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("v"))


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _before(amount: Column) -> Column:
    """Sum over the ranges of the file before this one."""
    w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(w), F.lit(0))


def _inside(amount: Column) -> Column:
    """Sum over the pieces of the range up to this one."""
    return F.sum(amount).over(Window.partitionBy(*_RANGE).orderBy("seq"))


def _joined(pieces: DataFrame, glue: str) -> DataFrame:
    """(file, record, text) of pieces (file, range, seq, v, record)."""
    parts = F.array_sort(F.collect_list(F.struct("range", "seq", "v")))
    return pieces.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["v"]), glue).alias("text"))


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each, with the line breaks inside
    their quoted values.  Quotes inside values are doubled.  Empty lines are no records; a quote that is never
    closed makes one record of the rest."""
    p = pieces(spark, path, "\n")
    p = p.withColumn("odd", _inside(_count(F.col("v"), quote)) % 2)  # after the line, seen from the range's start
    # one row per range: bounded by the files' bytes over the split size
    ranges = p.groupBy(*_RANGE).agg(F.max_by("odd", "seq").alias("turn"), F.count_if(F.col("odd") == 0).alias("e0"),
                                    F.count_if(F.col("odd") == 1).alias("e1"))
    ranges = ranges.withColumn("turned", _before(F.col("turn")) % 2)
    ranges = ranges.select(*_RANGE, "turned", _before(F.when(F.col("turned") == 0, F.col("e0")).otherwise(F.col("e1"))).alias("base"))
    p = p.join(F.broadcast(ranges), _RANGE)
    ends = (F.col("odd") + F.col("turned")) % 2 == 0
    p = p.withColumn("record", F.col("base") + _inside(ends.cast("long")) - ends.cast("long"))
    out = _joined(p.select(*_RANGE, "seq", "v", "record"), "\n")
    return out.withColumn("text", F.regexp_replace("text", "\r$", "")).where(F.trim("text") != "")


def read_multiline_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """CSV with a header and quoted values over several lines: all columns as text, files read in ranges.

    The names are those of the first file's header; every file's first record is taken as its header
    and must be the same."""
    rows = csv_records(spark, path, quote)
    heads = rows.where("record = 0").select("text").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{path}: {'no header' if not heads else 'files with different headers'}")
    names = next(csv.reader([heads[0]["text"].lstrip("\ufeff")], quotechar=quote))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    value = F.from_csv("text", schema, {"quote": quote, "escape": quote, "maxCharsPerColumn": "-1"})
    return rows.where("record > 0").select(value.alias("r")).select("r.*")


def json_objects(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(file, record, text): the objects of JSON files that stand ``depth`` brackets deep, as JSON text: 1 for an
    array of objects, 0 for objects one after another, 2 for the objects of an array inside an object."""
    p = pieces(spark, path, "}")
    bare = F.regexp_replace("v", r"(?s)\\.", "")  # without escaped characters
    p = p.withColumn("bare", bare).withColumn("q", _count(F.col("bare"), '"'))
    p = p.withColumn("odd0", (_inside(F.col("q")) - F.col("q")) % 2)  # before the piece, seen from the range's start

    def change(odd: Column) -> Column:
        """Depth gained by a piece and the brace that ends it, if it begins outside (0) or inside (1) a string."""
        out = F.regexp_replace(F.when(odd == 1, F.regexp_replace("bare", r'^[^"]*("|$)', "")).otherwise(F.col("bare")), r'"[^"]*("|$)', "")
        closed = (odd + F.col("q")) % 2 == 0
        return _count(out, "{") + _count(out, "[") - _count(out, "]") - closed.cast("int")

    p = p.withColumns({"c0": change(F.col("odd0")), "c1": change(1 - F.col("odd0"))})
    ranges = p.groupBy(*_RANGE).agg((F.sum("q") % 2).alias("turn"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    ranges = ranges.withColumn("turned", _before(F.col("turn")) % 2)
    ranges = ranges.select(*_RANGE, "turned", _before(F.when(F.col("turned") == 0, F.col("c0")).otherwise(F.col("c1"))).alias("deep"))
    p = p.join(F.broadcast(ranges), _RANGE)  # bounded: a row per range
    after = F.col("deep") + _inside(F.when(F.col("turned") == 0, F.col("c0")).otherwise(F.col("c1")))
    outside = (F.col("odd0") + F.col("turned") + F.col("q")) % 2 == 0
    p = p.withColumn("ends", (outside & (after == depth)).cast("long"))
    base = p.groupBy(*_RANGE).agg(F.sum("ends").alias("n")).select(*_RANGE, _before(F.col("n")).alias("base"))
    p = p.join(F.broadcast(base), _RANGE).withColumn("record", F.col("base") + _inside(F.col("ends")) - F.col("ends"))
    out = p.groupBy("file", "record").agg(F.max("ends").alias("whole"), F.array_sort(F.collect_list(F.struct("range", "seq", "v"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["v"]), "}"), F.lit("}"))
    lead = r'^\s*,?\s*' if depth == 0 else r"^[\s,\[]*" if depth == 1 else r'(?s)^\s*(\{\s*"[^"]*"\s*:\s*\[)?[\s,]*'
    return out.where("whole = 1").select("file", "record", F.regexp_replace(text, lead, "").alias("text"))
