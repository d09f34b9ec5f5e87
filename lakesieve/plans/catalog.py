"""All query plans of the core, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesieve.plans import activity, files, lines, redelivery

_PARTS = (lines, files, activity, redelivery)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["line_dedupe_exact"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for part in _PARTS for name, plan in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
