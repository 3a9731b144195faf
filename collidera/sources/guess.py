"""Types of text columns, guessed from all of their cells.

A cell has a set of types that it can be read as, and a column the types that all of its
cells share. Sets are bits of a number, and sharing is a bitwise *and*, so that one
aggregate with partial sums guesses all columns of a table. The narrowest type that is
left is the guess. A time of day is a type of its own and never becomes a timestamp; a
number with leading zeros is a code, not a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import cell

#: Types from the narrowest to the widest, and how their cells are spelled.
WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
DECIMAL = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TIME = r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "time": T.StringType(),
    "date": T.DateType(),
    "string": T.StringType(),
}


def readable_as(text: Column) -> dict[str, Column]:
    """For each type, whether a cell can be read as it."""
    whole = text.rlike(WHOLE)
    return {
        "int": whole & text.try_cast("int").isNotNull(),
        "bigint": whole & text.try_cast("bigint").isNotNull(),
        "double": text.rlike(DECIMAL) & text.try_cast("double").isNotNull(),
        "time": text.rlike(TIME),
        "date": text.rlike(DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(),
        "string": F.lit(True),
    }


def type_bits(text: Column) -> Column:
    """The types of a cell as bits, the narrowest one lowest; null for a null cell."""
    bits = F.lit(0)
    for place, able in enumerate(readable_as(text).values()):
        bits = bits + F.when(able, 1 << place).otherwise(0)
    return F.when(text.isNotNull(), bits)


def guess_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(position, column, type, n)`` of text columns; ``n`` counts the non-null cells.

    A column without a cell is ``string``. One pass over the rows.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in texts if columns is None or c in columns]
    if not chosen:
        return df.sparkSession.createDataFrame([], "position int, column string, type string, n bigint")
    found = df.agg(
        *[F.bit_and(type_bits(cell(c))).alias(f"bits{i}") for i, c in enumerate(chosen)],
        *[F.count(cell(c)).alias(f"n{i}") for i, c in enumerate(chosen)],
    )

    def narrowest(bits: Column) -> Column:
        first = F.lit("string")
        for place, name in reversed(list(enumerate(TYPES))):
            first = F.when(bits.bitwiseAND(1 << place) != 0, name).otherwise(first)
        return F.coalesce(F.when(bits.isNotNull(), first), F.lit("string"))

    rows = F.array(
        *[
            F.struct(
                F.lit(df.columns.index(c) + 1).alias("position"),
                F.lit(c).alias("column"),
                narrowest(F.col(f"bits{i}")).alias("type"),
                F.col(f"n{i}").alias("n"),
            )
            for i, c in enumerate(chosen)
        ]
    )
    return found.select(F.inline(rows))


def guessed(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, T.DataType]:
    """Guessed types by column."""
    return {r["column"]: TYPES[r["type"]] for r in guess_types(df, columns).collect()}


def retyped(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Text columns in their guessed types."""
    casts = {c: cell(c).try_cast(t) for c, t in types.items() if not isinstance(t, T.StringType)}
    return df.select(*[casts.get(c, cell(c)).alias(c) for c in df.columns])
