"""Queries by name, with their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: registers the query of this name."""

        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered already")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register
