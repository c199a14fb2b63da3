"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwire.plans import gate_queries, item_queries, source_queries, store_queries, stream_queries

_PARTS = (item_queries, gate_queries, store_queries, source_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
