"""A registry of queries, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sarraf.sources.catalog import Lake


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Register a function of a lake under its own name, with its SQL if there is one."""

        def add(function: Callable[[Lake], DataFrame]):
            self.queries[function.__name__] = lambda spark, folder: function(Lake(spark, folder))
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
