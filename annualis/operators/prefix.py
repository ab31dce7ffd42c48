"""Running sums over a whole table in the order of any columns, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annualis.session import cut_lineage


def prefix_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """``rows`` with, for each ``{new column: amount column}``, the sum of the amounts of all rows
    before it in the order of ``order`` (any orderable columns, nulls first; should tell all rows
    apart, or the order of ties is arbitrary but consistent).

    Rows are dealt into range partitions (as many as the session's shuffles have, or
    ``partitions``), each adds up its own, and a row's sum is what the partitions before it hold
    plus what stands before it inside.  The dealt rows are checkpointed: range bounds are sampled,
    so a partition that is computed again could be cut elsewhere.  Pass narrow rows."""
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(a).alias(f"_t{i}") for i, a in enumerate(sums.values())])
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_i{i}") for i, a in enumerate(sums.values())])
    out = out.join(F.broadcast(base), "_part")  # bounded: a row per partition
    return out.select(*rows.columns, *[(F.col(f"_b{i}") + F.col(f"_i{i}")).alias(name) for i, name in enumerate(sums)])
