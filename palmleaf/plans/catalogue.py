"""All queries of the engine by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palmleaf.plans import dictionary_queries, image_queries, ingest_queries, layout_queries, text_queries

_MODULES = (dictionary_queries, text_queries, layout_queries, ingest_queries, image_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
