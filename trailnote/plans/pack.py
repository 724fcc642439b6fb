"""A pack of named queries, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Pack:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the function below under its own name."""

        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.oracle[query.__name__] = sql
            return query

        return register
