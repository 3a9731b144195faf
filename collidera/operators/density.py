"""Gaussian kernel densities on an even grid, from value counts.

Values are first binned linearly onto an even grid that goes four bandwidths past the
curve on both sides: a value gives its weight to the two neighbouring points, the more
to the nearer one. The kernel is summed over these points and the curve is read off by
linear interpolation. A curve so costs a fixed number of terms, however many values it
is made of, and they are summed inside one array per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.functions.cells import quoted
from collidera.operators.attach import attach
from collidera.operators.counts import group_key, number_counts, profile
from collidera.operators.naming import apart
from collidera.sources.shared_folder import Settled, settled

# Grid size, bandwidths by which the grid of weights is wider than the
# curve, and the constants of the rule-of-thumb bandwidth.
POINTS = 512
WIDER = 4
IQR_TO_SD = 1.34
BANDWIDTH_FACTOR = 0.9


def _group_stats(counts: Settled, by: Sequence[str]) -> DataFrame:
    """Per group of two rows or more: ``n``, ``min``, ``max`` and bandwidth ``bw``.

    The bandwidth is 0.9 times the smaller of the sample deviation and the scaled
    quartile range, times n to the power of -1/5. Where that is zero, the
    deviation, then the size of the single value, then 1 takes its place.
    """
    stats = profile(counts, by, {"q1": 0.25, "q3": 0.75}).where(F.col("n") >= 2)
    spread = f"""
        case when least(sd, (q3 - q1) / {IQR_TO_SD}D) > 0 then least(sd, (q3 - q1) / {IQR_TO_SD}D)
          when sd > 0 then sd when min <> 0 then abs(min) else 1D end"""
    bw = F.expr(f"{BANDWIDTH_FACTOR}D * ({spread}) * power(n, -0.2D)")
    return stats.select(group_key(by).alias("_key"), "n", "min", "max", bw.alias("bw"))


def _curves(counts: Settled, curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, i, x, density)``; ``curves`` has ``_key, n, bw, lo, hi`` per group.

    The weights of a group's grid points become one array, which is folded with the kernel
    by array functions: all that moves between tasks is a row per group and grid point.
    """
    end = POINTS - 1
    groups = settled(
        curves.selectExpr(
            "_key",
            "n as _rows",
            "bw as _bw",
            "lo as _lo",
            "hi as _hi",
            f"lo - {WIDER} * bw as _left",
            f"(hi - lo + {2 * WIDER} * bw) / {end} as _step",
        )
    ).table
    shared = f"""inline(array(
        struct(least(int(floor(_at)), {end}) as _j, 1 - (_at - floor(_at)) as _share),
        struct(least(int(floor(_at)) + 1, {end}) as _j, _at - floor(_at) as _share)))"""
    weights = (
        counts.table.select(group_key(by).alias("_of"), F.col("v").alias("_v"), F.col("n").alias("_m"))
        .join(groups, F.col("_of") == F.col("_key"))
        .selectExpr("_of", "_m", "(_v - _left) / _step as _at")
        .selectExpr("_of", "_m", shared)
        .groupBy("_of", "_j")
        .agg(F.expr("sum(_m * _share)").alias("_w"))
        .groupBy("_of")
        .agg(F.map_from_entries(F.collect_list(F.struct("_j", "_w"))).alias("_weights"))
    )
    # A lambda over an array of one binds its argument, so that it is computed once.
    points = f"sequence(0, {end})"
    grid = f"transform({points}, j -> coalesce(try_element_at(_weights, j), 0D))"
    kernel = f"transform(sequence({-end}, {end}), d -> exp(-power(d * _step / _bw, 2) / 2))"
    products = f"zip_with(a.w, slice(a.k, {POINTS} - p, {POINTS}), (w, k) -> w * k)"
    sums = f"""transform(array(struct({grid} as w, {kernel} as k)),
        a -> transform({points}, p -> aggregate({products}, 0D, (total, x) -> total + x)))"""
    at = "(x - _left) / _step"
    between = f"""(1 - ({at} - floor({at}))) * y[least(int(floor({at})), {end})]
        + ({at} - floor({at})) * y[least(int(floor({at})) + 1, {end})]"""
    curve = f"""transform({sums}, y -> transform({points}, i -> transform(
        array(_lo + i * (_hi - _lo) / {end}),
        x -> struct(i as i, x as x, ({between}) / (_rows * _bw * sqrt(2 * pi())) as density))[0]))[0]"""
    return (
        groups.join(weights, F.col("_key") == F.col("_of"))
        .selectExpr("_key", f"inline({curve})")
        .selectExpr(*[f"_key.{quoted(b)} as {quoted(b)}" for b in by], "i", "x", "density")
    )


def _relative(curves: DataFrame, out: str) -> DataFrame:
    """Adds the density relative to the highest of all curves."""
    kept = settled(curves).table
    highest = kept.agg(F.max("density").alias("_peak"))
    return (
        attach(kept, highest)
        .withColumn(out, F.try_divide("density", "_peak"))
        .drop("_peak")
    )


@apart
def density(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, i, x, density)``: one curve per group over the range of all groups."""
    counts = number_counts(df, value, by, weight)
    span = counts.table.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    curves = attach(_group_stats(counts, by).select("_key", "n", "bw"), span)
    return _curves(counts, curves, by)


@apart
def ridges(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, i, x, density, height)``: curves with one common bandwidth.

    The bandwidth is the mean over the groups of two rows or more; the grid goes
    three bandwidths past the values. Groups under three rows have no curve.
    """
    counts = number_counts(df, value, by, weight)
    common = _group_stats(counts, by).agg(F.avg("bw").alias("bw"))
    ends = counts.table.agg(F.min("v").alias("min"), F.max("v").alias("max"))
    span = attach(ends, common).select(
        "bw",
        (F.col("min") - 3 * F.col("bw")).alias("lo"),
        (F.col("max") + 3 * F.col("bw")).alias("hi"),
    )
    groups = counts.table.groupBy(group_key(by).alias("_key")).agg(F.sum("n").alias("n"))
    curves = attach(groups.where(F.col("n") >= 3), span)
    return _relative(_curves(counts, curves, by), "height")


@apart
def violins(
    df: DataFrame, value: str, by: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*by, i, x, density, width)``: each curve over the range of its own group."""
    counts = number_counts(df, value, by, weight)
    curves = _group_stats(counts, by).select(
        "_key", "n", "bw", F.col("min").alias("lo"), F.col("max").alias("hi")
    )
    return _relative(_curves(counts, curves, by), "width")
