"""How a module of plans names its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self._queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self._sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a function of a table reader, t('orders') being that table."""

        def keep(f):
            if name in self._queries:
                raise ValueError(f"{name} is registered twice")
            self._queries[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            if sql:
                self._sql[name] = sql
            return f

        return keep

    def queries(self):
        return dict(self._queries)

    def oracle_sql(self):
        return dict(self._sql)
