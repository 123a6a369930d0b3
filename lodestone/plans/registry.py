"""All registered queries of the engine: name -> plan and name -> DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feedback_queries, item_queries, report_queries, search_queries, stream_queries, transcript_queries, upkeep_queries

_MODULES = (search_queries, item_queries, feedback_queries, report_queries, transcript_queries, stream_queries, upkeep_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.QUERIES["r_full_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
