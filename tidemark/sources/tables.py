"""Typed tables: parquet, delimited text, JDBC, and SQL over registered views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def delimited(
    spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True, glob: str | None = None
) -> DataFrame:
    """Delimited text under a declared schema; bad numbers become null."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    user: str | None = None,
    password: str | None = None,
    partition: tuple[str, int, int, int] | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. A partitioned read splits `column` over [low, high] in n ranges.

    Credentials come from the caller only.
    """
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if partition is None:
        opts["query" if query else "dbtable"] = query or table
    else:
        column, low, high, n = partition
        # The reader splits only a dbtable, so a query is wrapped as one.
        opts["dbtable"] = f"({query}) q" if query else table
        opts |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(n),
        }
    return opts


def jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    """Lazy remote table: filters and columns chosen later are pushed to the server."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def sql(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """SQL text with named parameters over registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)


def preview(df: DataFrame, n: int = 1, order_by: list | None = None) -> DataFrame:
    """A few rows for a look; repeatable when an order is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def catalog_columns(spark: SparkSession, pattern: str = ".*", table_pattern: str = ".*") -> DataFrame:
    """Columns of registered tables whose names match, with their types."""
    rows = [
        (t.name, c.name, c.dataType)
        for t in spark.catalog.listTables()
        for c in spark.catalog.listColumns(t.name)
    ]
    schema = "table_name string, column_name string, data_type string"
    return spark.createDataFrame(rows, schema).where(
        F.col("column_name").rlike(pattern) & F.col("table_name").rlike(table_pattern)
    )


def footer_search(spark: SparkSession, paths: dict[str, str], pattern: str) -> DataFrame:
    """Columns of Parquet tables whose names match, with type, number of values and of nulls.

    paths: table name -> path. The counts come from the row-group statistics in
    the file footers, read by tasks in parallel: a count over Parquet is pushed
    into the scan and no column data are read. That is a setting of the session,
    so the search runs in a sister session. Nested columns hold no such count and
    are scanned, by themselves.
    """
    sister = spark.newSession()
    sister.conf.set("spark.sql.sources.useV1SourceList", "")
    sister.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    out = None
    for name, path in paths.items():
        df = sister.read.parquet(path)
        found = [(c, k) for c, k in df.dtypes if re.search(pattern, c)]
        nested = [(c, k) for c, k in found if k.startswith(("array", "map", "struct", "variant"))]
        for columns in ([f for f in found if f not in nested], nested):
            if columns:
                one = _column_counts(df, name, columns)
                out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no column matches {pattern}")
    return out


def _column_counts(df: DataFrame, name: str, columns: list[tuple[str, str]]) -> DataFrame:
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, (c, _) in enumerate(columns)])
    rows = [
        F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(k).alias("data_type"),
            F.col(f"_n{i}").alias("n_values"), (F.col("_rows") - F.col(f"_n{i}")).alias("n_nulls"),
        )
        for i, (c, k) in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*rows)))
