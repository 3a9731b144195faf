"""Null counts, descriptive statistics and count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.functions.cells import cell
from collidera.operators.counts import (
    group_key,
    in_group,
    long_counts,
    profile,
    row_count,
    value_counts,
)
from collidera.operators.cube import Source, rows_of
from collidera.sources.shared_folder import Settled, settled


def null_counts_wide(
    df: DataFrame, columns: Sequence[str] | None = None, weight: str | None = None
) -> DataFrame:
    """One row with the number of nulls of each column."""

    def nulls(c: str) -> Column:
        step = F.lit(1).cast("bigint") if weight is None else cell(weight)
        return F.coalesce(F.sum(F.when(cell(c).isNull(), step)), F.lit(0)).alias(c)

    return df.agg(*[nulls(c) for c in columns or df.columns])


def null_counts(
    df: DataFrame, columns: Sequence[str] | None = None, weight: str | None = None
) -> DataFrame:
    """``(column, n_null)`` for the columns that have nulls."""
    wide = null_counts_wide(df, columns, weight)
    return wide.unpivot([], [cell(c) for c in wide.columns], "column", "n_null").where(F.col("n_null") > 0)


def describe(df: Source, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(metric, value)`` with mean, median, sample sd, min and max of each column.

    Nulls are left out. Metrics are named ``{column}_{statistic}``.
    """
    stats = profile(long_counts(df, columns, (), weight), ["column"], {"median": 0.5})
    long = stats.unpivot(["column"], ["mean", "median", "sd", "min", "max"], "stat", "value")
    return long.select(F.concat_ws("_", "column", "stat").alias("metric"), "value")


def area_summary(df: Source, weight: str | None = None) -> DataFrame:
    """Rows, mean and highest speed limit, median casualties per area, in level order.

    One aggregate over area and casualties holds all of it.
    """
    by = ["area_type", "area_ord"]
    df, weight = rows_of(df, [*by, "speed_limit", "number_of_casualties"], weight)
    speed = F.col("speed_limit").cast("double")
    step = F.lit(1).cast("bigint") if weight is None else cell(weight)
    seen = F.when(speed.isNotNull(), step)
    counted = df.groupBy(*by, F.col("number_of_casualties").cast("double").alias("v")).agg(
        F.sum(step).alias("n"),
        F.sum(speed * step).alias("_sum"),
        F.sum(seen).alias("_seen"),
        F.max(speed).alias("_max"),
    )
    kept = settled(counted)
    whole = kept.table.groupBy(group_key(by).alias("_key")).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("_sum"), F.sum("_seen")).alias("mean_speed"),
        F.max("_max").alias("max_speed"),
    )
    present = Settled(kept.table.where("v is not null").select(*by, "v", "n"), kept.rows)
    medians = profile(present, by, {"median": 0.5}).select(
        group_key(by).alias("_of"), F.col("median").alias("median_casualties")
    )
    return (
        whole.join(medians, F.col("_key").eqNullSafe(F.col("_of")), "left")
        .select(*in_group("_key", by), "n", "mean_speed", "median_casualties", "max_speed")
        .orderBy("area_ord")
        .drop("area_ord")
    )


def total_rows(df: Source, text: str, weight: str | None = None) -> DataFrame:
    """One row: the number of rows, and a sentence that ends with it."""
    df, weight = rows_of(df, [], weight)
    n = df.agg(F.coalesce(row_count(weight), F.lit(0)).alias("n"))
    return n.select("n", F.concat_ws(" ", F.lit(text), F.col("n").cast("string")).alias("message"))


def facet_counts(
    df: Source, panel: str, category: str, weight: str | None = None
) -> DataFrame:
    """Rows per (panel, category) and the largest count of the panel.

    Both are leveled categories, so a panel has as many rows as there are levels.
    """
    counts = value_counts(df, [panel, category], weight)
    return counts.withColumn("panel_max", F.max("n").over(Window.partitionBy(panel)))
