"""Putting the columns of a one-row table next to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of ``row``, an aggregate without groups.

    Such a table has one row whatever its input, so the broadcast has a fixed size
    and no row of ``df`` is lost or doubled.
    """
    return df.crossJoin(F.broadcast(row))
