"""Selecting, naming and adding columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def select_rename(df: DataFrame, **new_from_old) -> DataFrame:
    """Keep and rename in one step: select_rename(df, year="YEAR")."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in new_from_old.items()])


def transmute(df: DataFrame, **exprs: Column) -> DataFrame:
    """Keep only computed columns."""
    return df.select(*[e.alias(n) for n, e in exprs.items()])


def add_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def select_by_patterns(df: DataFrame, first: list[str], patterns: list[str], rest: bool = False) -> DataFrame:
    """Named columns, then those matching each pattern in turn, then maybe the rest."""
    chosen = list(first)
    for pattern in patterns:
        chosen += [c for c in df.columns if re.search(pattern, c) and c not in chosen]
    if rest:
        chosen += [c for c in df.columns if c not in chosen]
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def snake_name(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()


def clean_names(df: DataFrame, first: tuple[str, ...] = (), sort: bool = False) -> DataFrame:
    """snake_case names, repeats numbered; optionally name-sorted after `first`."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = snake_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    out = df.toDF(*names)
    if sort:
        out = out.select(*first, *sorted(c for c in names if c not in first))
    return out


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def with_expected_columns(df: DataFrame, expected: list[str], first: list[str], fill=0.0) -> DataFrame:
    """Add absent expected columns as `fill`, then fix the column order."""
    have = set(df.columns)
    return df.select(
        *first, *[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in expected]
    )


def distinct_text(df: DataFrame, value: str, by: list[str], out: str, sep: str = ", ") -> DataFrame:
    """Sorted distinct values of a small domain, joined into one text per group."""
    return df.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda v: v.cast("string")), sep).alias(out)
    )
