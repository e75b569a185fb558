"""All queries of the core with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans import data_queries, pipeline_queries, study_queries  # noqa: F401 (pipeline_queries adds to the study queries)

_PARTS = (study_queries, data_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for part in _PARTS for k, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.oracle_sql().items()}
