"""Queries with the SQL that states what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidymesh.table import Table, as_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name, each a table with its order where one is stated."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str, *order: str) -> Table:
        return as_table(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), order)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], Table | DataFrame]], Callable]:
    """Register a query under its function's name."""

    def register(fun: Callable[[Tables], Table | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_table(fun(Tables(spark, sf_dir))).df

        QUERIES[fun.__name__] = run
        if sql:
            ORACLES[fun.__name__] = sql
        return fun

    return register
