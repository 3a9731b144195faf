"""Report categories derived from the cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.functions.cells import as_text, hour_of
from collidera.functions.levels import (
    AREAS,
    SEVERITIES,
    UNKNOWN,
    WEEKDAYS,
    coded_levels,
    first_match,
    level_ordinal,
    level_value,
    weekend_flag,
)
from collidera.operators.attach import attach


def positional_category(
    df: DataFrame, column: str, labels: Sequence[str], out: str
) -> DataFrame:
    """The k-th smallest distinct value gets the k-th label; nulls stay null.

    Fails while running unless the column has exactly as many distinct values as
    there are labels: with a value missing, the labels would slide. One more
    value than there are labels proves that, so no more are gathered.
    """
    k = len(labels)
    values = (
        df.where(F.col(column).isNotNull())
        .select(column)
        .distinct()
        .limit(k + 1)
        .agg(F.sort_array(F.collect_list(column)).alias("_values"))
    )
    checked = values.select(
        F.when(F.size("_values") == k, F.col("_values"))
        .otherwise(F.raise_error(F.lit(f"{column}: number of distinct values is not {k}")))
        .alias("_values")
    )
    place = F.array_position("_values", F.col(column)).cast("int")
    label = F.try_element_at(F.array(*[F.lit(v) for v in labels]), place)
    return attach(df, checked).withColumn(out, label).drop("_values")


def time_features(
    df: DataFrame, weekend: str = "weekend", weekday: str = "weekday"
) -> DataFrame:
    """Adds ``hour``, ``day_ord`` and ``day_type``; an unlisted weekday becomes null."""
    return (
        df.withColumn("hour", hour_of(F.col("time")))
        .withColumn("day_of_week", level_value(F.col("day_of_week"), WEEKDAYS))
        .withColumn("day_ord", level_ordinal(F.col("day_of_week"), WEEKDAYS))
        .withColumn("day_type", weekend_flag(F.col("day_of_week"), weekend, weekday))
    )


def severity_features(df: DataFrame) -> DataFrame:
    """Adds ``severity`` and ``severity_ord`` from the sorted distinct severities."""
    return positional_category(df, "collision_severity", SEVERITIES, "severity").withColumn(
        "severity_ord", level_ordinal(F.col("severity"), SEVERITIES)
    )


def labelled_severity(df: DataFrame) -> DataFrame:
    """Adds ``severity`` and ``severity_ord`` from codes or labels, row by row.

    A severity that is neither a listed code nor a label ends as null.
    """
    known = first_match(as_text(df, "collision_severity"), coded_levels(SEVERITIES), UNKNOWN)
    return df.withColumn("severity", level_value(known, SEVERITIES)).withColumn(
        "severity_ord", level_ordinal(F.col("severity"), SEVERITIES)
    )


def area_features(df: DataFrame) -> DataFrame:
    """Adds area and severity categories and keeps rows of a known area.

    Rows of an unknown severity are kept.
    """
    return named_areas(df).where(known_area())


def named_areas(df: DataFrame) -> DataFrame:
    """Adds area and severity categories; rows of an unknown area are kept."""
    area = first_match(as_text(df, "urban_or_rural_area"), coded_levels(AREAS), UNKNOWN)
    return labelled_severity(df.withColumn("area_type", area)).withColumn(
        "area_ord", level_ordinal(F.col("area_type"), AREAS)
    )


def known_area() -> Column:
    return F.col("area_type") != UNKNOWN
