"""Row filters."""

from __future__ import annotations

from functools import reduce

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import member
from .windows import group_value


def in_range(df: DataFrame, col: str, low=None, high=None, open_ends: bool = False) -> DataFrame:
    """Rows inside a closed (default) or open interval; either end may be absent."""
    c = F.col(col)
    tests = []
    if low is not None:
        tests.append(c > F.lit(low) if open_ends else c >= F.lit(low))
    if high is not None:
        tests.append(c < F.lit(high) if open_ends else c <= F.lit(high))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def keep_members(df: DataFrame, col: str, values, exclude=()) -> DataFrame:
    test = member(col, values)
    if exclude:
        test = test & ~member(col, exclude)
    return df.where(test)


def keep_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(F.col(col).rlike(pattern))


def require_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols))


def drop_known(df: DataFrame, col: str, bad_values) -> DataFrame:
    """Drop rows with a known bad id; rows with a missing id stay."""
    return df.where(~member(col, bad_values))


def drop_listed(df: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """Drop rows whose key is in an exclusion table."""
    return df.join(bad.select(*on).distinct(), on, "left_anti")


def groups_with_a_value(df: DataFrame, by: list[str], col: str, raw: bool = True) -> DataFrame:
    """Keep groups that hold at least one non-null value."""
    if raw:
        keep = df.where(F.col(col).isNotNull()).select(*[F.col(b).alias(f"_k_{b}") for b in by]).distinct()
        # A missing key is a group like any other.
        match = functools.reduce(lambda a, b: a & b, [df[b].eqNullSafe(keep[f"_k_{b}"]) for b in by])
        return df.join(keep, match, "left_semi")
    return group_value(df, by, F.count(col), "_n", raw=False).where("_n > 0").drop("_n")


def group_minimum(df: DataFrame, by: list[str], value: str, raw: bool = True) -> DataFrame:
    """Rows that hold their group's minimum, ties kept."""
    return group_value(df, by, F.min(value), "_min", raw=raw).where(F.col(value) == F.col("_min")).drop("_min")


def beyond(df: DataFrame, col: str, threshold: float) -> DataFrame:
    return df.where(F.abs(F.col(col)) > F.lit(threshold))


def drop_empty_vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows in which every listed column is null."""
    return df.dropna(how="all", subset=cols)


def fleet_flag(fleet: Column, *rules: tuple[Column, int]) -> Column:
    """Turn rows off by a negative fleet number; a later rule overrides an earlier one."""
    out = fleet
    for test, code in rules:
        out = F.when(test, F.lit(code)).otherwise(out)
    return out.cast("int")
