"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

import listwright

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SENT: set[str] = set()


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, folder)`` as a query, with its SQL if it has one."""

    def add(fn):
        @wraps(fn)
        def run(spark, folder):
            send_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def send_package(spark: SparkSession) -> None:
    """Gives the tasks' Python this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    source = Path(listwright.__file__).parent
    folder = Path(SparkFiles.getRootDirectory()) / "package"  # the driver's own, gone with the session
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "listwright_package.zip"
    with zipfile.ZipFile(path, "w") as made:
        for file in sorted(source.rglob("*.py")):
            made.write(file, Path(source.name) / file.relative_to(source))
    context.addPyFile(str(path))
