"""Explicit null rules.

The source scripts rely on missing values that spread through sums, compare
as unknown, and still match in joins. Spark's defaults differ, so every rule
has a named function here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_sum(x: ColumnLike) -> Column:
    """Sum that is null as soon as one input row is null."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def lenient_sum(x: ColumnLike) -> Column:
    """Sum that skips nulls; a group with only nulls sums to 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def strict_mean(x: ColumnLike) -> Column:
    """Mean that is null as soon as one input row is null."""
    x = _c(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def row_sum(*cols: ColumnLike, skip_null: bool = False) -> Column:
    """Sum across columns of one row."""
    terms = [_c(c) for c in cols]
    if skip_null:
        terms = [F.coalesce(t, F.lit(0.0)) for t in terms]
    return reduce(lambda a, b: a + b, terms)


def member(x: ColumnLike, values) -> Column:
    """Membership test that answers false, never null, for a null input."""
    return F.coalesce(_c(x).isin(list(values)), F.lit(False))


def if_else(test: Column, yes, no) -> Column:
    """Three-way conditional: an unknown test gives null, not the else branch."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(test.isNull(), F.lit(None)).when(test, yes).otherwise(no)


def coalesce_value(x: ColumnLike, fallback) -> Column:
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(_c(x), fallback)


def recode(x: ColumnLike, mapping: dict, default=None, keep_unmapped: bool = False) -> Column:
    """Map values by a dictionary; others get `default` or stay as they are."""
    x = _c(x)
    out = None
    for key, value in mapping.items():
        out = F.when(x == F.lit(key), F.lit(value)) if out is None else out.when(x == F.lit(key), F.lit(value))
    other = x if keep_unmapped else F.lit(default)
    return other if out is None else out.otherwise(other)


def to_number(x: ColumnLike, kind: str = "double") -> Column:
    """Text to number; text that is no number becomes null."""
    return _c(x).try_cast(kind)


def null_safe_equal(left: Column, right: Column) -> Column:
    """Join condition under which two missing keys match."""
    return left.eqNullSafe(right)
