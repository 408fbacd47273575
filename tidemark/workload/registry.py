"""Registry of bound queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import configure
from ..sources.tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The supplied tables by name: t.lineitem, t.orders, ...

    A table's schema is read from its footer once per process; later reads
    declare it, which saves a job each.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        key = f"{self.folder}/{name}"
        df = parquet(self.spark, self.folder, name, _SCHEMAS.get(key))
        _SCHEMAS[key] = df.schema
        setattr(self, name, df)
        return df


def query(name: str, sql: str | None = None):
    """Register a function of Tables under `name`, with the SQL that must agree."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap
