"""Report on hour of day and weekday."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from collidera.operators.correlation import lower_triangle, spearman
from collidera.operators.counts import value_counts
from collidera.operators.cube import Cube
from collidera.operators.density import density, ridges
from collidera.operators.derive import labelled_severity, severity_features, time_features
from collidera.operators.histogram import histogram
from collidera.operators.shares import log_stack
from collidera.operators.summary import describe, null_counts_wide
from collidera.sources.shared_folder import settled

CHECKED = ["time", "day_of_week", "collision_severity", "number_of_casualties"]
# Sets of columns whose counts the tables below are made of.
SETS = [
    ["hour"],
    ["number_of_casualties"],
    ["hour", "number_of_casualties"],
    ["number_of_vehicles", "number_of_casualties"],
    ["hour", "speed_limit"],
    ["number_of_casualties", "speed_limit"],
    ["day_type", "hour"],
    ["day_of_week", "day_type", "hour"],
    ["day_of_week", "hour"],
    ["hour", "collision_severity"],
]


def features(
    cleaned: DataFrame, weekend: str = "weekend", weekday: str = "weekday"
) -> DataFrame:
    """Hour, weekday and kind of day, named as asked for, and severity."""
    return labelled_severity(time_features(cleaned, weekend, weekday))


def add_features(cleaned: DataFrame) -> DataFrame:
    """The columns of ``SETS``."""
    return features(cleaned)


def of_cube(cube: Cube) -> Cube:
    """The part of a cube over ``SETS`` that the report is about: all of it."""
    return cube


def missing_values(cleaned: DataFrame) -> DataFrame:
    return null_counts_wide(cleaned, CHECKED)


def description(df: DataFrame, weight: str | None = None) -> DataFrame:
    return describe(df, ["hour", "number_of_casualties"], weight)


def correlation(df: DataFrame, weight: str | None = None) -> DataFrame:
    pairs = [("hour", "number_of_casualties"), ("number_of_vehicles", "number_of_casualties")]
    return spearman(df, pairs, "everything", weight)


def correlations(df: DataFrame, weight: str | None = None) -> DataFrame:
    return lower_triangle(df, ["hour", "number_of_casualties", "speed_limit"], weight)


def hour_bins(df: DataFrame, weight: str | None = None) -> DataFrame:
    return histogram(df, "hour", width=1, weight=weight)


def hour_density(df: DataFrame, weight: str | None = None) -> DataFrame:
    return density(df, "hour", ["day_type"], weight)


def weekday_ridges(df: DataFrame, weight: str | None = None) -> DataFrame:
    return ridges(df, "hour", ["day_of_week", "day_type"], weight)


def heatmap(df: DataFrame, weight: str | None = None) -> DataFrame:
    return value_counts(df, ["day_of_week", "hour"], weight)


def severity_stack(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Severities are labelled by position, which needs no more than their counts."""
    counts = settled(value_counts(df, ["hour", "collision_severity"], weight)).table
    return log_stack(severity_features(counts), "hour", "severity", "severity_ord", "n")


# The tables of the report, over ``features`` or over counts of ``COLUMNS``.
TABLES: dict[str, Callable[..., DataFrame]] = {
    table.__name__: table
    for table in (
        description,
        correlation,
        correlations,
        hour_bins,
        hour_density,
        weekday_ridges,
        heatmap,
        severity_stack,
    )
}
