"""The operators bound to the given tables, each with the same question in SQL.

Every query reads whole tables. Cases that the tables do not hold, such as a broken
manifest, are derived from their columns: all rows stay, the language, source or
event type of a row decides which form it takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must agree with it."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register
