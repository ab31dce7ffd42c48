"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the result is expressible in plain SQL, the DuckDB text of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util

    for mod in MODULES:
        name = f"annualis.plans.{mod}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)


MODULES = ["q_retrieval", "q_text", "q_extract", "q_select", "q_scored", "q_context", "q_metrics", "q_io", "q_streaming"]
