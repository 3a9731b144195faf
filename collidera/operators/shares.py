"""Shares of a group total and stacked bars.

Groups, bars and categories are columns with a level list or hours of a day, so
the windows below see as many rows of a group as there are levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.functions.cells import all_present
from collidera.functions.numbers import log10_count, percent
from collidera.operators.counts import value_counts
from collidera.operators.cube import Source, rows_of


def stack_top(height: Column, bar: str, ordinal: str) -> Column:
    """Upper end of a segment: the first level lies on top, nulls at the bottom."""
    upwards = (
        Window.partitionBy(bar)
        .orderBy(F.desc_nulls_first(ordinal))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum(height).over(upwards)


def category_share(
    df: Source, group: str, category: str, ordinal: str, weight: str | None = None
) -> DataFrame:
    """``(group, category, ordinal, n, pct)``: percent of the group; nulls left out."""
    df, weight = rows_of(df, [group, category, ordinal], weight)
    counts = value_counts(
        df.where(all_present(group, category)), [group, category, ordinal], weight
    )
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("pct", percent(F.col("n"), total))


def filled_stack(
    df: Source, group: str, category: str, ordinal: str, weight: str | None = None
) -> DataFrame:
    """Shares stacked to 1: ``share``, ``ymin`` and ``ymax`` of every segment."""
    shares = category_share(df, group, category, ordinal, weight)
    whole = F.sum("pct").over(Window.partitionBy(group))
    return (
        shares.withColumn("share", F.try_divide("pct", whole))
        .withColumn("ymax", stack_top(F.col("share"), group, ordinal))
        .withColumn("ymin", F.col("ymax") - F.col("share"))
    )


def log_stack(
    df: DataFrame, bar: str, category: str, ordinal: str, weight: str | None = None
) -> DataFrame:
    """Stacked base-10 logarithms of counts.

    The logarithm is taken per segment and the segments are stacked afterwards, so
    a bar is as high as the sum of the logarithms. Rows without a bar are left out,
    a null category is a segment of its own.
    """
    counts = value_counts(df.where(F.col(bar).isNotNull()), [bar, category, ordinal], weight)
    return (
        counts.withColumn("log_n", log10_count(F.col("n")))
        .withColumn("ymax", stack_top(F.col("log_n"), bar, ordinal))
        .withColumn("ymin", F.col("ymax") - F.col("log_n"))
    )
