"""Structure preview of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from collidera.functions.cells import cell


COLUMNS = "position int, column string, type string, first_values string, n_rows bigint"


def structure(df: DataFrame, first: int = 5, n_rows: int | None = None) -> DataFrame:
    """``(position, column, type, first_values, n_rows)``, one row per column.

    ``first_values`` shows the column in the ``first`` rows that lead when the table is
    sorted by all its columns; a null shows as ``NA``. One scan finds these rows, as each
    task keeps no more than ``first``, and counts all rows on the way. Where ``n_rows`` is
    known, the table's own first rows are shown and no more than they is read.
    """
    texts = [F.coalesce(cell(c).cast("string"), F.lit("NA")) for c in df.columns]
    if n_rows is None:
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"))
        head = counted.orderBy(*map(cell, df.columns)).limit(first).select(*texts).collect()
        n_rows = seen.get["n_rows"]
    else:
        head = df.limit(first).select(*texts).collect()
    rows = [
        (i, field.name, field.dataType.simpleString(), ", ".join(r[i - 1] for r in head), n_rows)
        for i, field in enumerate(df.schema, start=1)
    ]
    return df.sparkSession.createDataFrame(rows, COLUMNS)
