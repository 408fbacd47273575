"""Rounding rules and printed numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, _c


def round_even(x: ColumnLike, digits: int = 0) -> Column:
    """Round to the nearer candidate; an exact tie goes to the even digit (statistical scripts).

    Distances to both candidates are taken in double arithmetic from the stored
    number, not from its printed form: 0.15 is stored nearer to 0.1 and becomes
    0.1, 0.65 becomes 0.7, and 0.25 is a tie and becomes 0.2.
    """
    x = _c(x)
    if digits <= 0:
        return F.bround(x, digits)
    scale = 10.0**digits
    whole = F.floor(x * scale)
    low, high = whole / F.lit(scale), F.ceil(x * scale) / F.lit(scale)
    down = (x - low < high - x) | ((x - low == high - x) & (whole % 2 == 0))
    # Numbers this large have no decimals left to round.
    large = F.isnan(x) | (F.abs(x) >= 1e15 / scale)
    return F.when(large, x).when(down, low).otherwise(high)


def round_away(x: ColumnLike, digits: int = 0) -> Column:
    """Ties go away from zero (database SQL)."""
    return F.round(_c(x), digits)


def round_by_size(x: ColumnLike, small_digits: int = 2, large_digits: int = 0) -> Column:
    """Below 1: small_digits; above 1: large_digits; exactly 1 and null stay."""
    x = _c(x)
    return F.when(x < 1, round_even(x, small_digits)).when(x > 1, round_even(x, large_digits)).otherwise(x)


def retained_percent(part: ColumnLike, whole: ColumnLike) -> Column:
    """100 times the rounded share that is not `part`."""
    return F.lit(100.0) * round_even(F.lit(1.0) - F.try_divide(_c(part), _c(whole)), 2)


def with_commas(x: ColumnLike, digits: int = 0) -> Column:
    return F.format_number(_c(x), digits)


def value_sd_text(value: Column, sd: Column) -> Column:
    """"value (sd)", with a blank for whichever is missing."""
    blank = F.lit("")
    return F.concat(F.coalesce(value, blank), F.lit(" ("), F.coalesce(sd, blank), F.lit(")"))


def mask_small(x: ColumnLike, text: str = "<1") -> Column:
    """Print a rounded zero as `text`."""
    x = _c(x)
    rounded = F.bround(x, 0)
    return F.when(rounded == 0, F.lit(text)).otherwise(rounded.cast("long").cast("string"))


def blank_zero(x: ColumnLike) -> Column:
    x = _c(x)
    return F.when(x == 0, F.lit("")).otherwise(x.cast("string"))
