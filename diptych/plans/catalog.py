"""Registration of queries, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its name, with the SQL that says what it returns where SQL can."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[make.__name__] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            SQL[make.__name__] = sql
        return make

    return register
