"""All queries of the library with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics_queries, browse_queries, registry, retrieval_queries, state_queries, text_queries

_MODULES = (retrieval_queries, analytics_queries, text_queries, browse_queries, state_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.d18_two_stage(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
