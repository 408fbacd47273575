"""Binding a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    A column that a lambda mentions is otherwise put into the lambda's body by
    the optimizer, and evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]
