"""Expressions on single cells: text, nulls, dates and times of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(name: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """A column name as SQL takes it literally."""
    return f"`{name.replace('`', '``')}`"


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; an integral double is written without ``.0``."""
    col = cell(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (F.abs(col) < 1e15) & (F.rint(col) == col)
        return F.when(whole, F.when(whole, col).cast("bigint").cast("string")).otherwise(
            col.cast("string")
        )
    return col.cast("string")


def member(col: Column, values: list[str]) -> Column:
    """Membership that is false, never null, for a null cell."""
    return F.coalesce(col.isin(*values), F.lit(False))


def all_present(*names: str) -> Column:
    """True where every named column is non-null."""
    present = F.lit(True)
    for name in names:
        present = present & cell(name).isNotNull()
    return present


def blank_values(col: Column, values: Column) -> Column:
    """Null where the cell is in the array ``values``; exact, case-sensitive."""
    return F.when(~F.array_contains(values, col), col)


def to_int(col: Column) -> Column:
    """Text to integer, however the number is spelled (``30``, ``30.0``, ``3e1``).

    Text that is not a whole number gives null; ``rejected`` tells such text.
    """
    number = col.try_cast("double")
    return F.when(F.rint(number) == number, number).try_cast("int")


def rejected(col: Column) -> Column:
    """True for text that is there but would not become an integer."""
    return col.isNotNull() & to_int(col).isNull()


def parse_day_first_date(col: Column) -> Column:
    """``d/m/yyyy`` text to date.

    One-digit days and months are accepted, text after the year is ignored, and
    anything else, the 31st of February included, gives null.
    """
    day_first = F.regexp_extract(col, r"^\s*(\d{1,2}/\d{1,2}/\d{4})", 1)
    return F.try_to_date(day_first, "d/M/yyyy")


def hour_of(col: Column) -> Column:
    """Hour of ``HH:mm`` text, 0 to 23; null where there is none."""
    hour = F.when(col.contains(":"), F.substring_index(col, ":", 1)).try_cast("int")
    return F.when(hour.between(0, 23), hour)
