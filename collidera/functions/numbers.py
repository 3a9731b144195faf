"""Numeric expressions on report rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """Round with ties to the even digit."""
    return F.bround(col, digits)


def log10_count(n: Column) -> Column:
    """Base-10 logarithm of a count; an empty bin has none."""
    return F.log10(n)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100
