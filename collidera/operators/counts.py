"""Value counts, and order statistics computed from them.

Every statistic of the reports depends on a column only through how often each
value occurs, so a table is reduced to ``(group, value, n)`` first, with partial
aggregation before the shuffle, and the rest runs on distinct values. All
operators take an optional ``weight`` column, so that a table of counts can stand
in for the rows it was counted from.

Counts are written to the shared folder. Quantiles are found by refining histograms over
them (``selection``). Where the rank of every value is asked for, counts are written in
ranges of group and value, as many as their size asks for, and each row remembers its
range; totals per range then give every range its start, and no task ever holds all
values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.functions.cells import cell, quoted
from collidera.operators.cube import Cube, Source
from collidera.operators.selection import at_ranks
from collidera.sources.shared_folder import Settled, settled


def row_count(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def value_counts(
    df: Source, columns: Sequence[str], weight: str | None = None
) -> DataFrame:
    """``(*columns, n)``: rows per combination of values, nulls kept as a value."""
    if isinstance(df, Cube):
        return df.of(columns)
    return df.groupBy(*map(cell, columns)).agg(row_count(weight).alias("n"))


def ranged(counts: DataFrame, by: Sequence[str] = ()) -> Settled:
    """``counts`` of values ``v``, settled in ranges of group and value.

    The range of a row is written with it and never computed again. Equal values of
    a group are in one range, null values stay out of the result.
    """
    placed = counts.repartitionByRange(*map(cell, by), "v").withColumn(
        "_range", F.spark_partition_id()
    )
    kept = settled(placed)
    return Settled(kept.table.where(F.col("v").isNotNull()), kept.rows)


def number_counts(
    df: Source, value: str, by: Sequence[str] = (), weight: str | None = None
) -> Settled:
    """``(*by, v, n)``: settled counts of the non-null values of a numeric column.

    Nulls are dropped from the counts, not from the rows: a filter below the
    aggregate would compute a derived column twice per row.
    """
    number = cell(value).cast("double")
    counts = value_counts(df, [*by, value], weight)
    kept = settled(counts.select(*map(cell, by), number.alias("v"), "n"))
    return Settled(kept.table.where(F.col("v").isNotNull()), kept.rows)


def long_counts(
    df: Source, values: Sequence[str], by: Sequence[str] = (), weight: str | None = None
) -> Settled:
    """``(*by, column, v, n)``: settled counts of several columns from one scan.

    Rows are unfolded before they are counted: the columns are counted apart, so it
    does not matter how many combinations of their values there are.
    """
    if isinstance(df, Cube):
        parts = [
            df.of([*by, c]).select(
                *map(cell, by), F.lit(c).alias("column"), cell(c).cast("double").alias("v"), "n"
            )
            for c in values
        ]
        found = settled(reduce(DataFrame.unionByName, parts))
        return Settled(found.table.where(F.col("v").isNotNull()), found.rows)
    kept = [*by, weight] if weight else [*by]
    numbers = df.select(*map(cell, kept), *[cell(c).cast("double").alias(c) for c in values])
    cells = numbers.unpivot([*map(cell, kept)], [*map(cell, values)], "column", "v")
    found = settled(value_counts(cells, [*by, "column", "v"], weight))
    return Settled(found.table.where(F.col("v").isNotNull()), found.rows)


def group_key(by: Sequence[str]) -> Column:
    """One never-null key for a group; a null inside it equals another null."""
    return F.struct(*map(cell, by)) if by else F.lit(0)


def in_group(name: str, by: Sequence[str]) -> list[Column]:
    """The columns of a group from its key."""
    return [F.col(name).getField(b).alias(b) for b in by]


def running_counts(counts: Settled, by: Sequence[str] = ()) -> DataFrame:
    """Adds to ``(*by, v, n)``: rows below it, rows of the group, mean of the group.

    Equal values in several rows count as lying one below the other. ``counts`` comes
    from ``ranged``.
    """
    table = counts.table.withColumn("_key", group_key(by))
    per_range = table.groupBy("_key", "_range").agg(
        F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("v")).alias("_nv")
    )
    group = Window.partitionBy("_key")
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(group)
    starts = per_range.select(
        "_key",
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        total.alias("total"),
        (F.sum("_nv").over(group) / total).alias("mean"),
    )
    below = (
        Window.partitionBy("_key", "_range")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("_start") + F.coalesce(F.sum("n").over(below), F.lit(0))
    kept = [cell(c) for c in counts.table.columns if c != "_range"]
    return table.join(starts, ["_key", "_range"]).select(
        *kept, before.alias("before"), "total", "mean"
    )


def profile(
    counts: Settled, by: Sequence[str] = (), quantiles: dict[str, float] | None = None
) -> DataFrame:
    """``(*by, n, mean, sd, min, max, *quantiles)`` per group of value counts.

    ``sd`` is the sample deviation, null for one row. Quantiles are exact and
    interpolate linearly between the two neighbouring rows.
    """
    quantiles = quantiles or {}
    keyed = counts.table.select(group_key(by).alias("_key"), "v", "n")
    groups = settled(
        keyed.groupBy("_key").agg(
            F.sum("n").alias("total"),
            F.expr("sum(n * v) / sum(n)").alias("mean"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.count("*").alias("values"),
        )
    ).table
    means = groups.select(F.col("_key").alias("_of"), "mean")
    squares = (
        keyed.join(means, F.col("_key") == F.col("_of"))
        .groupBy(F.col("_key").alias("_sq"))
        .agg(F.expr("sum(n * (v - mean) * (v - mean))").alias("_squares"))
    )
    out = groups.join(squares, F.col("_key") == F.col("_sq"))
    if quantiles:
        places = [
            F.expr(f"{side}((total - 1) * {p}D)")
            for p in quantiles.values()
            for side in ("floor", "ceil")
        ]
        found = at_ranks(keyed, groups, places, rows=counts.rows).withColumnRenamed("_key", "_rk")
        out = out.join(found, F.col("_key") == F.col("_rk"))

    def between(name: str, p: float) -> str:
        spot = f"(total - 1) * {p}D"
        low, high = (f"by_rank[{side}({spot})]" for side in ("floor", "ceil"))
        return f"{low} + ({spot} - floor({spot})) * ({high} - {low}) as {quoted(name)}"

    return out.selectExpr(
        *[f"_key.{quoted(b)} as {quoted(b)}" for b in by],
        "total as n",
        "mean",
        "sqrt(try_divide(_squares, total - 1)) as sd",
        "min",
        "max",
        *[between(name, p) for name, p in quantiles.items()],
    )
