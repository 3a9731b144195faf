"""Spearman rank correlation from value counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.functions.cells import cell
from collidera.functions.numbers import round_even
from collidera.operators.counts import ranged, row_count, running_counts
from collidera.operators.cube import Cube, Source
from collidera.sources.shared_folder import settled

Pair = tuple[str, str]


def spearman(
    df: Source, pairs: Sequence[Pair], missing: str = "pairwise", weight: str | None = None
) -> DataFrame:
    """``(var1, var2, n, correlation)`` for each pair of numeric columns.

    ``missing="pairwise"`` ranks within the rows where both columns are present;
    ``missing="everything"`` gives null for a pair as soon as one row lacks either.
    A constant column or fewer than two rows give null. ``n`` counts complete rows.
    All pairs share one scan that counts each pair's value combinations.
    """
    if missing not in ("pairwise", "everything"):
        raise ValueError(f"missing: {missing!r}")

    def number(c: str) -> Column:
        return cell(c).cast("double")

    if isinstance(df, Cube):
        counted = [
            df.of([a, b]).select(F.lit(i).alias("pair"), number(a).alias("x"), number(b).alias("y"), "n")
            for i, (a, b) in enumerate(pairs)
        ]
        return _from_counts(reduce(DataFrame.unionByName, counted), pairs, missing)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("_pair"), number(a).alias("_x"), number(b).alias("_y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    weights = [] if weight is None else [cell(weight).alias("_weight")]
    counted = (
        df.select(F.inline(cells), *weights)
        .groupBy(F.col("_pair").alias("pair"), F.col("_x").alias("x"), F.col("_y").alias("y"))
        .agg(row_count("_weight" if weight else None).alias("n"))
    )
    return _from_counts(counted, pairs, missing)


def _from_counts(counted: DataFrame, pairs: Sequence[Pair], missing: str) -> DataFrame:
    """Correlations from ``(pair, x, y, n)``."""
    combos = settled(counted).table
    sums = _rank_sums(combos, F.col("x").isNotNull() & F.col("y").isNotNull())

    ratio = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    bounded = F.greatest(F.least(ratio, F.lit(1.0)), F.lit(-1.0))
    r = F.when(ratio.isNotNull(), bounded)
    if missing == "everything":
        r = F.when(F.col("incomplete") == 0, r)

    def variable(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)

    return sums.select(
        variable(0).alias("var1"), variable(1).alias("var2"), "n", r.alias("correlation")
    )


def _rank_sums(combos: DataFrame, whole: Column) -> DataFrame:
    """Sums over centred average ranks of each pair.

    Ranks are found on the distinct values of each column. The second column's
    ranks are joined first and added up per value of the first column, so that one
    row per value is left when the first column's ranks are joined. Adaptive
    execution splits a value that pairs with very many others.
    """
    complete = combos.where(whole)
    sides = F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("v")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("v")),
    )
    margins = ranged(
        complete.select("pair", F.inline(sides), "n")
        .groupBy("pair", "side", "v")
        .agg(F.sum("n").alias("n")),
        ["pair", "side"],
    )
    centred = F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
    ranked = settled(
        running_counts(margins, ["pair", "side"]).select("pair", "side", "v", centred.alias("centred"))
    ).table
    ranked_x = ranked.where(F.col("side") == "x").select(
        "pair", F.col("v").alias("x"), F.col("centred").alias("cx")
    )
    ranked_y = ranked.where(F.col("side") == "y").select(
        "pair", F.col("v").alias("y"), F.col("centred").alias("cy")
    )
    per_x = (
        complete.join(ranked_y, ["pair", "y"])
        .groupBy("pair", "x")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("cy")).alias("cy"),
            F.sum(F.col("n") * F.col("cy") * F.col("cy")).alias("cyy"),
        )
    )
    cx = F.col("cx")
    sums = (
        per_x.join(ranked_x, ["pair", "x"])
        .groupBy("pair")
        .agg(
            F.sum("n").alias("n"),
            F.sum(cx * F.col("cy")).alias("xy"),
            F.sum(F.col("n") * cx * cx).alias("xx"),
            F.sum("cyy").alias("yy"),
        )
    )
    present = combos.groupBy("pair").agg(
        F.sum(F.when(whole, 0).otherwise(F.col("n"))).alias("incomplete")
    )
    return present.join(sums, "pair", "left").fillna(0, ["n"])


def lower_triangle(df: Source, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Pairwise-complete correlations of every two columns, with a one-digit label."""
    pairs = list(combinations(columns, 2))
    return spearman(df, pairs, "pairwise", weight).withColumn(
        "label", round_even(F.col("correlation"), 1)
    )


def matrix(df: Source, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(var1, var2, correlation, label)`` for every ordered pair, the diagonal 1.

    A pair is null when a row lacks one of its columns. The label has two digits.
    """
    half = spearman(df, list(combinations(columns, 2)), "everything", weight)
    cells = F.array(
        F.struct("var1", "var2", "correlation"),
        F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "correlation"),
    )
    both = half.select(F.explode(cells).alias("cell")).select("cell.*")
    names = F.explode(F.array(*[F.lit(c) for c in columns]))
    diagonal = (
        half.sparkSession.range(1)
        .select(names.alias("var1"))
        .select("var1", F.col("var1").alias("var2"), F.lit(1.0).alias("correlation"))
    )
    return both.unionByName(diagonal).withColumn("label", round_even(F.col("correlation"), 2))
