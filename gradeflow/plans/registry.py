"""Every registered query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, gate_queries, grading_queries, learner_queries, record_queries, table_queries, text_queries, value_queries

_MODULES = (table_queries, text_queries, value_queries, grading_queries, record_queries, gate_queries, feature_queries, learner_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_queries.auroc_by_language(spark, sf_dir)
