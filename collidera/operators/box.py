"""Box plot statistics from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.functions.cells import cell
from collidera.operators.counts import (
    group_key,
    in_group,
    number_counts,
    profile,
)
from collidera.operators.naming import apart

# Fixed value: quartile ranges a whisker may span.
WHISKER = 1.5
QUARTILES = {"lower": 0.25, "middle": 0.5, "upper": 0.75}


def _fenced(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None
) -> DataFrame:
    """Value counts with the quartiles of their group and an ``outside`` mark."""
    counts = number_counts(df, value, by, weight)
    boxes = profile(counts, by, QUARTILES).select(
        group_key(by).alias("_key"), F.col("n").alias("rows"), *QUARTILES
    )
    reach = (F.col("upper") - F.col("lower")) * WHISKER
    outside = (F.col("v") < F.col("lower") - reach) | (F.col("v") > F.col("upper") + reach)
    keyed = counts.table.withColumn("_key", group_key(by))
    return keyed.join(boxes, "_key").withColumn("outside", outside)


@apart
def box_stats(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, n, ymin, lower, middle, upper, ymax, n_outliers)`` per group.

    Whiskers end at the extreme values within 1.5 quartile ranges of the box, and
    never inside it.
    """
    within = F.when(~F.col("outside"), F.col("v"))
    beyond = F.when(F.col("outside"), F.col("n")).otherwise(0)
    summed = (
        _fenced(df, value, by, weight)
        .groupBy("_key", "rows", *QUARTILES)
        .agg(
            F.min(within).alias("low"),
            F.max(within).alias("high"),
            F.sum(beyond).alias("n_outliers"),
        )
    )
    return summed.select(
        *in_group("_key", by),
        F.col("rows").alias("n"),
        F.least("lower", "low").alias("ymin"),
        *QUARTILES,
        F.greatest("upper", "high").alias("ymax"),
        "n_outliers",
    )


@apart
def box_outliers(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, x, n)``: the values beyond the whiskers and how often they occur."""
    return _fenced(df, value, by, weight).where("outside").select(
        *map(cell, by), F.col("v").alias("x"), "n"
    )
