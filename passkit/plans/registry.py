"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``. The oracle is an
independent SQL statement over the same parquet tables, written against
the views of ``oracle_views`` (never generated from the Spark plan).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn`` under ``name``; ``sql`` is its oracle (None = rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from passkit.plans import (  # noqa: F401
        scoring_queries, evaluation_queries, extraction_queries, request_queries,
        measurement_queries, source_queries, plugin_queries, streaming_queries)
