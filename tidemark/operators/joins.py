"""Joins.

No broadcast hints: the planner broadcasts a side whose file size is below
spark.sql.autoBroadcastJoinThreshold, AQE does the same for a finished stage
of measured size, and anything larger is a sort-merge join whose skewed
partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stored


def measured(df: DataFrame) -> DataFrame:
    """Write a small derived table to the shared scratch folder and read it back.

    The planner then knows its real size: a join with it is a broadcast only
    below spark.sql.autoBroadcastJoinThreshold, and a sort-merge join
    otherwise. The estimate of an aggregate over large facts is always too
    high, and the facts would be shuffled before run-time statistics exist.
    """
    return stored(df, "measured")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Natural join under which missing keys match each other."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = term if cond is None else cond & term
    out = left.join(r, cond, how)
    if how in ("right", "full", "full_outer", "outer"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_r_{k}")) for k in keys})
    return out.drop(*[f"_r_{k}" for k in keys])


def with_scalar(df: DataFrame, one_row: DataFrame, *cols: str) -> DataFrame:
    """Add columns of a one-row table. It fails if the table has more than one row."""
    fields = one_row.select(F.struct(*cols).alias("_one")).scalar()
    return df.withColumn("_one", fields).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in cols])


def aligned_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Replace column binding by position: join by key, marking rows one side lacks.

    `aligned` is false where the key is absent on either side, so a caller can
    assert that the two tables really line up.
    """
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    out = a.join(b, keys, "full_outer")
    return out.withColumn("aligned", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def relabel_unlisted(
    df: DataFrame, keep: DataFrame, keys: list[str], label_col: str, other: str
) -> DataFrame:
    """Rows whose key is not in `keep` get the label `other`."""
    listed = keep.select(*keys).distinct().withColumn("_listed", F.lit(True))
    out = df.join(listed, keys, "left")
    return out.withColumn(
        label_col, F.when(F.col("_listed").isNull(), F.lit(other)).otherwise(F.col(label_col))
    ).drop("_listed")


def expand_grid(df: DataFrame, **levels) -> DataFrame:
    """All combinations of each row with the given level vectors.

    A level vector is a Python list or an array column. The rows fan out inside
    their own partition: no join and no shuffle.
    """
    for name, values in levels.items():
        arr = F.array(*[F.lit(v) for v in values]) if isinstance(values, (list, tuple)) else values
        df = df.withColumn(name, F.explode(arr))
    return df
