"""Right-closed histograms that keep empty bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.functions.numbers import log10_count
from collidera.operators.attach import attach
from collidera.operators.counts import group_key, in_group, number_counts
from collidera.operators.naming import apart

# Relative slack at a bin border, and the bin width for a single value.
SLACK = 1e-8
POINT_WIDTH = 0.1
# Bins unfolded from one row at a time.
BLOCK = 4096


@apart
def histogram(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    width: float | None = None,
    bins: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(*by, bin, xmin, xmax, x, n, log_n)`` for every group and bin.

    With ``width`` the borders lie half a width off its multiples. With ``bins``
    the range of all groups is cut so that the first bin is centred on the lowest
    value and the last on the highest. A value on a border belongs to the lower
    bin. Nulls are left out.
    """
    if (width is None) == (bins is None):
        raise ValueError("give either width or bins")
    counts = number_counts(df, value, by, weight).table
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    layout = ends.select(*_layout(F.col("lo"), F.col("hi"), width, bins))
    binned = attach(counts, layout).select(
        *by, _bin_of(F.col("v")).alias("bin"), "origin", "width", "n"
    )
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    empty = _each_bin(attach(groups, layout)).select(
        *by, "bin", "origin", "width", F.lit(0).cast("bigint").alias("n")
    )
    left = F.col("origin") + F.col("bin") * F.col("width")
    return (
        binned.unionByName(empty)
        .groupBy(group_key(by).alias("_key"), "bin")
        .agg(F.max("origin").alias("origin"), F.max("width").alias("width"), F.sum("n").alias("n"))
        .select(
            *in_group("_key", by),
            "bin",
            left.alias("xmin"),
            (left + F.col("width")).alias("xmax"),
            (left + F.col("width") / 2).alias("x"),
            "n",
            log10_count(F.col("n")).alias("log_n"),
        )
    )


def _layout(lo: Column, hi: Column, width: float | None, bins: int | None) -> list[Column]:
    """Left border of the first bin, bin width, number of bins; null without values."""
    if width is not None:
        w, border = F.lit(float(width)), F.lit(width / 2)
    elif bins == 1:
        w = F.when(hi > lo, hi - lo).otherwise(POINT_WIDTH)
        border = F.when(hi > lo, lo).otherwise(POINT_WIDTH / 2)
    else:
        w = F.when(hi > lo, (hi - lo) / (bins - 1)).otherwise(POINT_WIDTH)
        border = F.when(hi > lo, lo - w / 2).otherwise(POINT_WIDTH / 2)
    origin = border + F.floor((lo - border) / w) * w
    whole = F.greatest(F.floor((hi + (1 - SLACK) * w - origin) / w + 1e-10), F.lit(1))
    return [
        origin.alias("origin"),
        w.alias("width"),
        F.when(lo.isNotNull(), whole).alias("bins"),
    ]


def _bin_of(v: Column) -> Column:
    place = F.ceil((v - F.col("origin")) / F.col("width") - SLACK) - 1
    return F.greatest(place, F.lit(0))


def _each_bin(groups: DataFrame) -> DataFrame:
    """One row per group and bin, unfolded in two steps so that no array holds all bins."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1, F.lit(BLOCK)))
    block_end = F.least(F.col("_start") + BLOCK - 1, F.col("bins") - 1)
    blocks = groups.withColumn("_start", start).repartition("_start")
    return blocks.withColumn("bin", F.explode(F.sequence("_start", block_end)))
