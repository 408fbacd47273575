"""Text helpers for labels, ids and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, _c


def paste(*parts: ColumnLike, sep: str = "", null_text: str = "NA") -> Column:
    """Join parts; a missing part prints as `null_text`."""
    return F.concat_ws(sep, *[F.coalesce(_c(p).cast("string"), F.lit(null_text)) for p in parts])


def strip_pattern(x: ColumnLike, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(_c(x), pattern, replacement)


def comma_number(x: ColumnLike) -> Column:
    """Number printed with thousands commas back to a double."""
    return F.regexp_replace(_c(x), ",", "").try_cast("double")


def part_of(x: ColumnLike, index: int, sep: str = "_", limit: int = -1) -> Column:
    """The index-th (from 1) piece of a separated label, null when absent."""
    return F.get(F.split(_c(x), sep, limit), F.lit(index - 1))


def base_name(path: ColumnLike) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_name(path: ColumnLike) -> Column:
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-2))


def title_case(x: ColumnLike) -> Column:
    return F.initcap(_c(x))


def fixed_slice(x: ColumnLike, start: int, length: int) -> Column:
    return F.substring(_c(x).cast("string"), start, length)
