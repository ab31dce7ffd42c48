"""Small helpers shared by the operators: written scratch tables, token rules, batch
plumbing between Spark and numpy."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.session import checkpoint_dir

#: A word: a maximal run of letters, digits and underscores (Unicode).
WORD = re.compile(r"\w+")
#: A word of letters only.
LETTERS = re.compile(r"[^\W\d_]+")

HELD_OUT_REMAINDER = 2


def scratch_path(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder the cluster names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read again:
    later jobs neither recompute it nor depend on an executor that computed it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(id_col: str = "doc_id"):
    """True for the rows no model may learn from: crc32(id as text) mod 4 is 2 (null ids: False)."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(rest == HELD_OUT_REMAINDER, F.lit(False))


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], "pa.Array"]) -> DataFrame:
    """The rows of ``df`` for which ``keep`` (a function of an Arrow batch, giving a boolean
    array) is true; every column is passed through unchanged, whatever its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(keep(b))

    return df.mapInArrow(run, df.schema)


def slices_by_size(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(start, end) ranges of ``texts`` holding about ``most`` characters each; a longer
    text is a range of its own, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
