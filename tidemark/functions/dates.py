"""Calendar rules used by weekly catch reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, _c

# Month-first spellings met in weekly report files (fixed values).
MONTH_FIRST_FORMATS = ("M/d/yyyy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy")
SHORT_YEAR_FORMATS = ("M/d/yy", "M-d-yy")
# Two-digit years from this one on belong to the last century (fixed value).
CENTURY_TURN = 69


def parse_month_first(x: ColumnLike) -> Column:
    """Month-day-year text to a date; text in no known spelling becomes null."""
    x = F.trim(_c(x))
    full = [F.try_to_timestamp(x, F.lit(fmt)).cast("date") for fmt in MONTH_FIRST_FORMATS]
    # A four-digit-year pattern also accepts two digits as the first century.
    full = [F.when(F.year(d) >= 1000, d) for d in full]
    short = [F.try_to_timestamp(x, F.lit(fmt)).cast("date") for fmt in SHORT_YEAR_FORMATS]
    short = [F.when(F.year(d) >= 2000 + CENTURY_TURN, F.add_months(d, -1200)).otherwise(d) for d in short]
    return F.coalesce(*full, *short)


def week_of_year(d: ColumnLike) -> Column:
    """Seven-day blocks counted from 1 January (not ISO weeks)."""
    return (F.floor((F.dayofyear(_c(d)) - 1) / 7) + 1).cast("int")


def month_name(d: ColumnLike) -> Column:
    return F.date_format(_c(d), "MMMM")


def quarter_name(d: ColumnLike) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_c(d)).cast("string"))
