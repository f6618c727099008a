"""Named queries: each is a function (spark, sf_dir) -> DataFrame, with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftline.runtime import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")

            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add


core = Registry()
