"""Report on urban against rural areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from collidera.operators.box import box_outliers, box_stats
from collidera.operators.correlation import matrix
from collidera.operators.counts import value_counts
from collidera.operators.density import violins
from collidera.operators.cube import Cube
from collidera.operators.derive import area_features, known_area, named_areas
from collidera.operators.histogram import histogram
from collidera.operators.shares import category_share, filled_stack
from collidera.operators.summary import area_summary, facet_counts, total_rows

# Sets of columns whose counts the tables below are made of; each names the area.
SETS = [
    ["area_type"],
    ["area_type", "area_ord", "speed_limit", "number_of_casualties"],
    ["area_type", "number_of_vehicles", "number_of_casualties"],
    ["area_type", "number_of_casualties"],
    ["area_type", "speed_limit"],
    ["area_type", "severity", "severity_ord"],
]
ROWS_TEXT = "Rows to analyse:"


def features(cleaned: DataFrame) -> DataFrame:
    return area_features(cleaned)


def add_features(cleaned: DataFrame) -> DataFrame:
    """The columns of ``SETS``, with rows of unknown areas."""
    return named_areas(cleaned)


def of_cube(cube: Cube) -> Cube:
    """The part of a cube over ``SETS`` that the report is about."""
    return cube.where("area_type", known_area())


def rows(df: DataFrame, weight: str | None = None) -> DataFrame:
    return total_rows(df, ROWS_TEXT, weight)


def summary(df: DataFrame, weight: str | None = None) -> DataFrame:
    return area_summary(df, weight)


def correlations(df: DataFrame, weight: str | None = None) -> DataFrame:
    return matrix(df, ["number_of_vehicles", "number_of_casualties"], weight)


def casualty_boxes(df: DataFrame, weight: str | None = None) -> DataFrame:
    return box_stats(df, "number_of_casualties", ["area_type"], weight)


def casualty_outliers(df: DataFrame, weight: str | None = None) -> DataFrame:
    return box_outliers(df, "number_of_casualties", ["area_type"], weight)


def area_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    return value_counts(df, ["area_type"], weight)


def speed_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    return value_counts(df, ["speed_limit", "area_type"], weight)


def speed_violins(df: DataFrame, weight: str | None = None) -> DataFrame:
    return violins(df, "speed_limit", ["area_type"], weight)


def severity_facets(df: DataFrame, weight: str | None = None) -> DataFrame:
    return facet_counts(df, "area_type", "severity", weight)


def severity_shares(df: DataFrame, weight: str | None = None) -> DataFrame:
    return category_share(df, "area_type", "severity", "severity_ord", weight)


def severity_fill(df: DataFrame, weight: str | None = None) -> DataFrame:
    return filled_stack(df, "area_type", "severity", "severity_ord", weight)


def speed_bins(df: DataFrame, weight: str | None = None) -> DataFrame:
    return histogram(df, "speed_limit", ["area_type"], bins=15, weight=weight)


# The tables of the report, over ``features`` or over counts of ``COLUMNS``.
TABLES: dict[str, Callable[..., DataFrame]] = {
    table.__name__: table
    for table in (
        rows,
        summary,
        correlations,
        casualty_boxes,
        casualty_outliers,
        area_counts,
        speed_counts,
        speed_violins,
        severity_facets,
        severity_shares,
        severity_fill,
        speed_bins,
    )
}
