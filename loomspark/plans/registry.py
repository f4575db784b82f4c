"""How a module of queries collects them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.session import open_table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """A folder's tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return open_table(self.spark, self.folder, name)


def collector() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator registers a function of Tables under its own name."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return register

    return queries, oracles, query
