"""Connected components of a link table by alternating large-star / small-star steps.

Every step is a partial ``min`` per node and a join on the node, so a node with a third of
all links is pre-aggregated before the shuffle and its join partition can be split by AQE.
Nothing but two numbers per round (row count and a checksum, to see that nothing moved)
reaches the driver; each round's links are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import written


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id that occurs in a link, the smallest id reachable.

    Null ends and self links are ignored; repeated links and both directions are fine; an
    empty table gives an empty result."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = written(e.select(hi.cast("long").alias("hi"), lo.cast("long").alias("lo")).distinct(), "links")
    before = _signature(e)
    if not before[0]:
        return e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    while True:
        # large star: every larger neighbour of u is linked to the smallest id around u
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # small star: u and its smaller neighbours are linked to the smallest of these
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.inline(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")),
                             F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))))
        e = written(small.where("hi <> lo").distinct(), "links")
        after = _signature(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)
