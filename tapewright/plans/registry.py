"""All queries by name, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewright.plans import bar_queries, evidence_queries, feature_queries, model_queries, oracle, panel_queries, selection_queries, store_queries, stream_queries  # noqa: F401  the modules register their queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(oracle.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
