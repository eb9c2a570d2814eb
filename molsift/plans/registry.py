"""Registry of named queries: a Spark plan and, where SQL can say it, its
DuckDB twin. Plan modules register with the ``query`` decorator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``ops`` lists the inventory ids the query exercises; ``sql`` is the oracle
    text (views added by the caller with ``with_views``), or None when the
    operator has no SQL twin.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(ops.split()))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import catalog  # noqa: F401  (registers on import)
    return QUERIES
