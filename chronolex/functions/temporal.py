"""Predicates over half-open validity intervals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def require_as_of(as_of: date) -> date:
    """The date itself: every look-up names its date, there is no default."""
    if not isinstance(as_of, date):
        raise TypeError("as_of must be a date")
    return as_of


def _day(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(require_as_of(as_of)).cast("date")


def in_force(as_of, valid_from: str | Column = "valid_from", valid_to: str | Column = "valid_to") -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (valid_from, valid_to))
    return (start <= _day(as_of)) & (end.isNull() | (end > _day(as_of)))


def edge_in_force(as_of, valid_from: str | Column = "valid_from", valid_to: str | Column = "valid_to") -> Column:
    """As in_force, but an edge without a start has always been."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (valid_from, valid_to))
    return (start.isNull() | (start <= _day(as_of))) & (end.isNull() | (end > _day(as_of)))
