"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_access, q_dataset, q_deid, q_network, q_pixels, q_query, q_stores, q_validate

MODULES = [q_query, q_access, q_dataset, q_validate, q_deid, q_pixels, q_network, q_stores]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_query.flagship(spark, sf_dir)
