"""Registry of named queries over the driver tables.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with, where
the semantics are SQL-expressible, the equivalent DuckDB SQL over the same
tables (views named like the Parquet files).  Column names and types agree
between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return wrap


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from . import (  # noqa: F401
        queries_catalog,
        queries_code,
        queries_links,
        queries_search,
        queries_similarity,
        queries_snapshots,
        queries_text,
        queries_vectors,
    )


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE_SQL)
