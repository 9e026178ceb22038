"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, tables)`` as a query, with its SQL if it has one."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(spark, Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        fn.sql = sql
        return fn

    return add


def also(name: str, **options):
    """Registers a query a second time with other sizes, such as those that make an operator take the
    way it takes on large tables. The rows are the same."""

    def add(fn):
        return query(name, fn.sql)(lambda spark, tables: fn(spark, tables, **options)) and fn

    return add
