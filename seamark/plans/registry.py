"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query (spark, sf_dir) -> DataFrame under its name, with its SQL if there is some."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import queries_code, queries_graph, queries_more, queries_scopes, queries_search, queries_smart, queries_sources, queries_streams  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over documents and embeddings."""
    return QUERIES["r7_hybrid_search"](spark, sf_dir)
