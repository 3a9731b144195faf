"""The values at given ranks, found by refining histograms.

A wanted rank lies in a bracket of values that starts as the whole range of its group. A
pass counts each bracket's values in bins, with partial aggregation, and keeps the bin
that holds the rank, cut to the values that are really in it. Passes go on until no
bracket has more than ``few`` distinct values; only those are put in order. Nothing is
sorted by value before, and a pass shuffles no more than ``bins`` rows per bracket and task.

Bins are even in the values in one pass and in their logarithm in the next, so that
neither wide nor narrow spreads take many passes. Every pass takes the smallest or the
largest value away from the others, so the passes end whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.sources.shared_folder import settled

BINS = 1024
FEW = 4096
#: Decimal places below the largest value of a bracket that logarithmic bins reach.
PLACES = 12


def bin_of(even: bool, bins: int) -> Column:
    """Bin of ``v`` in ``[lo, hi]``: never falling, the ends in the first and last bin.

    Where the width of the range or a place in it is no number, infinite values among
    them, all values between the ends share a bin.
    """
    if even:
        # Halves, so that the width of the widest range is finite.
        share = "(v / 2 - lo / 2) / (hi / 2 - lo / 2)"
    else:
        unit = f"greatest(abs(lo), abs(hi)) * 1e-{PLACES}D"

        def log(x: str) -> str:
            return f"signum({x}) * log1p(try_divide(abs({x}), {unit}))"

        share = f"try_divide({log('v')} - {log('lo')}, {log('hi')} - {log('lo')})"
    place = f"cast(greatest(least(nanvl({share}, 0.5D), 1D), 0D) * {bins} as int)"
    inner = f"greatest(least(coalesce({place}, {bins // 2}), {bins - 1}), 0)"
    return F.expr(f"case when v <= lo then 0 when v >= hi then {bins - 1} else {inner} end")


def brackets_of(groups: DataFrame, ranks: Sequence[Column]) -> DataFrame:
    """One bracket per group: the whole range, with the ranks that are wanted."""
    return groups.select(
        "_key",
        F.col("min").alias("lo"),
        F.col("max").alias("hi"),
        F.lit(0).cast("long").alias("below"),
        "values",
        F.array_distinct(F.array(*[r.cast("long") for r in ranks])).alias("ranks"),
    )


def _inside(counts: DataFrame, brackets: DataFrame) -> DataFrame:
    """Counts that lie in a bracket, next to it."""
    joined = counts.join(brackets.withColumnRenamed("_key", "_of"), F.col("_key") == F.col("_of"))
    return joined.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_of")


def _hit(start: Column, size: Column) -> Column:
    return F.filter("ranks", lambda r: (r >= start) & (r < start + size))


def refined(counts: DataFrame, brackets: DataFrame, even: bool, bins: int) -> DataFrame:
    """Brackets of the bins that hold a wanted rank."""
    binned = (
        _inside(counts, brackets)
        .select("_key", "lo", "below", "ranks", "v", "n", bin_of(even, bins).alias("bin"))
        .groupBy("_key", "lo", "below", "ranks", "bin")
        .agg(
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            F.sum("n").alias("n"),
            F.count("*").alias("values"),
        )
    )
    earlier = Window.partitionBy("_key", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    found = binned.withColumn("_start", start)
    return (
        found.withColumn("ranks", _hit(F.col("_start"), F.col("n")))
        .where(F.size("ranks") > 0)
        .select(
            "_key",
            F.col("low").alias("lo"),
            F.col("high").alias("hi"),
            F.col("_start").alias("below"),
            "values",
            "ranks",
        )
    )


def at_ranks(
    counts: DataFrame,
    groups: DataFrame,
    ranks: Sequence[Column],
    bins: int = BINS,
    few: int = FEW,
    rows: int | None = None,
) -> DataFrame:
    """``(_key, by_rank)``: a map from each wanted zero-based rank to the value there.

    ``counts`` has ``(_key, v, n)`` and ``groups`` a row per key with ``min``, ``max`` and
    the number of rows of ``counts``, ``values``; both are settled, as they are read in every pass.
    ``ranks`` are expressions over ``groups``. ``rows`` says how many rows ``counts`` has,
    where that is known: no group has more, so few rows need no look at the groups.
    """
    brackets, even = brackets_of(groups, ranks), True
    while (rows is None or rows > few) and (brackets.agg(F.max("values")).first()[0] or 0) > few:
        brackets = settled(refined(counts, brackets, even, bins)).table
        # A bracket of one value needs no further pass, however often it is counted.
        if brackets.where((F.col("lo") < F.col("hi")) & (F.col("values") > few)).isEmpty():
            break
        even = not even
    earlier = Window.partitionBy("_key", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        _inside(counts, brackets)
        .groupBy("_key", "lo", "below", "ranks", "v")
        .agg(F.sum("n").alias("n"))
    )
    start = F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    placed = inside.withColumn("_start", start)
    hits = placed.select("_key", "v", F.explode(_hit(F.col("_start"), F.col("n"))).alias("rank"))
    pairs = F.map_from_entries(F.collect_list(F.struct("rank", "v")))
    return hits.groupBy("_key").agg(pairs.alias("by_rank"))
