"""Queries register here by name, with their SQL where they have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


_STORED: dict[tuple[str, str, str], str] = {}


def is_stored(spark: SparkSession, folder: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, folder, name) in _STORED


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table built from the tables of a folder, written once a session and read by all queries that start from it.

    The tables of a folder are taken not to change during a session.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if not is_stored(spark, folder, name):
        path = new_folder(spark, name)
        build(spark, folder).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
