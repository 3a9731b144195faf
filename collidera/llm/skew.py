"""Joins of many rows per key with one row per key, whatever the key's share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this part of all rows is hot; so there are fewer hot keys
#: than this number, at any size.
PARTS = 10_000


def lookup(
    rows: DataFrame, per_key: DataFrame, key: str, total: int, how: str = "inner"
) -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row per non-null ``key``.

    ``per_key`` has a column ``_n``, how many of the ``total`` rows have the key; it is
    not returned. Rows of a hot key never meet in one task: fewer than ``PARTS`` keys can
    hold more than ``total / PARTS`` rows, and these keys are broadcast. All other rows
    take a join on the key. Both tables are read twice, so hand in settled ones.
    """
    is_hot = F.col("_n") > total / PARTS
    hot = F.broadcast(per_key.filter(is_hot).drop("_n"))
    rest = per_key.filter(~is_hot).drop("_n")
    served = rows.join(hot, key)
    others = rows.join(hot.select(key), key, "left_anti").join(rest, key, how)
    return served.unionByName(others)
