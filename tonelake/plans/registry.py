"""All queries of the library by name, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, calibration_queries, catalog_queries, clip_queries, document_queries, loudness_queries, measurement_queries, parameter_queries, signal_queries, space_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = parameter_queries.QUERIES | measurement_queries.QUERIES | audit_queries.QUERIES | calibration_queries.QUERIES | space_queries.QUERIES | signal_queries.QUERIES | loudness_queries.QUERIES | document_queries.QUERIES | clip_queries.QUERIES | catalog_queries.QUERIES
ORACLE_SQL: dict[str, str] = parameter_queries.SQL | measurement_queries.SQL | audit_queries.SQL | calibration_queries.SQL | space_queries.SQL | signal_queries.SQL | loudness_queries.SQL | document_queries.SQL | clip_queries.SQL | catalog_queries.SQL
