"""A catalogue of named queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wayledger.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipping(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str, *args, **more) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir, *args, **more)

    return run


class Catalog:
    """Queries by name; ``sql`` holds the ones that plain SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = _shipping(f)
            if sql:
                self.sql[name] = sql
            return f

        return add

    def merge(self, *others: Catalog) -> Catalog:
        for other in others:
            for name, f in other.queries.items():
                self.query(name, other.sql.get(name))(f)
        return self
