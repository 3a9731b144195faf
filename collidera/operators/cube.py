"""Row counts over several sets of columns from one scan.

A report asks for many statistics of few columns each. Counting all combinations of all
columns once would be the table itself as soon as one column is fine-grained; grouping
sets count each set of columns apart, in one aggregate with partial sums, so that every
table of the report finds counts no larger than its own columns make them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import cell
from collidera.sources.shared_folder import new_path


@dataclass(frozen=True)
class Cube:
    """Counts ``(*columns, n)`` by set of columns."""

    tables: dict[frozenset[str], DataFrame]

    def where(self, column: str, condition: Column) -> Cube:
        """The rows that meet a condition on a column, in the sets that have it."""
        return Cube({s: t.where(condition) for s, t in self.tables.items() if column in s})

    def of(self, columns: Sequence[str]) -> DataFrame:
        """``(*columns, n)``, from the smallest set that has the columns."""
        able = [s for s in self.tables if s.issuperset(columns)]
        if not able:
            raise KeyError(f"no set of the cube has {', '.join(columns)}")
        chosen = min(able, key=len)
        table = self.tables[chosen]
        if len(chosen) > len(set(columns)):
            table = table.groupBy(*map(cell, columns)).agg(F.sum("n").alias("n"))
        return table.select(*map(cell, columns), "n")


def counted_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``(*columns, set, n)``: rows per combination of each set; other columns are null.

    ``set`` is the set's place in ``sets``. A column name with a dot is taken as it is.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[cell(c) for c in s] for s in sets], *map(cell, columns))
    counted = grouped.agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("n"))
    place = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sets))):
        left_out = sum(1 << k for k, c in enumerate(reversed(columns)) if c not in s)
        place = F.when(F.col("_id") == left_out, i).otherwise(place)
    return counted.select(*map(cell, columns), place.alias("set"), "n")


def cubed(df: DataFrame, sets: Sequence[Sequence[str]], path: str | None = None) -> Cube:
    """Count the sets in one scan, write them to ``path`` or the shared folder, read them back."""
    distinct = [tuple(s) for s in {frozenset(s): s for s in sets}.values()]
    path = path or new_path(df.sparkSession, "cube")
    counted = counted_sets(df, distinct)
    counted.write.mode("overwrite").partitionBy("set").option("compression", "zstd").parquet(path)
    schema = T.StructType([f for f in counted.schema if f.name != "set"]).add("set", T.IntegerType())
    whole = df.sparkSession.read.schema(schema).parquet(path)
    return Cube(
        {
            frozenset(s): whole.where(F.col("set") == i).select(*map(cell, s), "n")
            for i, s in enumerate(distinct)
        }
    )


Source = DataFrame | Cube


def rows_of(source: Source, columns: Sequence[str], weight: str | None) -> tuple[DataFrame, str | None]:
    """A table with the columns and the name of its weight, from rows, counts or a cube."""
    if isinstance(source, Cube):
        return source.of(list(dict.fromkeys(columns))), "n"
    return source, weight
