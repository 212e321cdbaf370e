"""Registration of queries with the SQL that says the same, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FUNCTIONS: dict[str, Callable] = {}


class Tables:
    """The tables of a data folder, read on first use: t.orders, t.lineitem ... `floor` is the least confidence of the steps
    that projection.depends() follows; None follows all."""

    def __init__(self, spark: SparkSession, folder: str, floor: float | None = 0.985):
        self.spark, self.folder, self.floor = spark, folder, floor

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df


def query(name: str, sql: str | None = None):
    """Registers f(tables) -> DataFrame as a query; sql is its oracle."""

    def add(f):
        FUNCTIONS[name] = f
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add
