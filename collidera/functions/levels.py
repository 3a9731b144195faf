"""Ordered categories: a text value together with its place in a level list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import member

# Category levels in report order.
WEEKDAYS = [
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
]
WEEKEND = ["Saturday", "Sunday"]
SEVERITIES = ["Fatal", "Serious", "Slight"]
AREAS = ["Urban", "Rural"]
UNKNOWN = "Unknown"
LEVELS = {"day_of_week": WEEKDAYS, "area_type": AREAS, "severity": SEVERITIES}


def level_value(col: Column, levels: Sequence[str]) -> Column:
    """The value when it is one of the levels, else null."""
    return F.when(col.isin(*levels), col)


def level_ordinal(col: Column, levels: Sequence[str]) -> Column:
    """1-based place in the level list, null for an unlisted or null value."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(place > 0, place).cast("int")


def in_level_order(df: DataFrame) -> DataFrame:
    """Report rows sorted for reading: categories by level, other keys by value, nulls last."""
    keys = [f.name for f in df.schema if not isinstance(f.dataType, T.DoubleType)]
    order = [
        level_ordinal(F.col(c), LEVELS[c]).asc_nulls_last() if c in LEVELS else F.asc_nulls_last(c)
        for c in keys
    ]
    return df.orderBy(*order) if order else df


def first_match(col: Column, cases: Sequence[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first case whose list holds the text; ``default`` else."""
    (label, values), *rest = cases
    out = F.when(col.isin(*values), label)
    for label, values in rest:
        out = out.when(col.isin(*values), label)
    return out.otherwise(default)


def coded_levels(levels: Sequence[str]) -> list[tuple[str, list[str]]]:
    """Cases that accept the k-th level as its label or as the code ``k``."""
    return [(level, [str(k), level]) for k, level in enumerate(levels, start=1)]


def weekend_flag(day: Column, weekend: str = "weekend", weekday: str = "weekday") -> Column:
    """Weekend or weekday label; a null day counts as a weekday."""
    return F.when(member(day, WEEKEND), weekend).otherwise(weekday)
