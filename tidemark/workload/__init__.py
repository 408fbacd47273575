"""Operators bound to the supplied tables, each with its SQL twin."""

from . import catch, checks, columns, models, relational, scalars, scenarios, survey, text_io  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
