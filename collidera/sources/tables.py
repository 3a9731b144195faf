"""CSV and Parquet tables.

Text tables are read with explicit types, or types guessed by the library: Spark's inference
would turn a time of day into a timestamp of today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import cell, to_int
from collidera.sources.guess import guessed, retyped
from collidera.sources.records import records

# Known columns that are not read as text.
RAW_TYPES: dict[str, T.DataType] = {
    "collision_year": T.IntegerType(),
    "number_of_vehicles": T.IntegerType(),
    "number_of_casualties": T.IntegerType(),
}
CLEANED_TYPES: dict[str, T.DataType] = {
    "date": T.DateType(),
    "speed_limit": T.IntegerType(),
    "number_of_vehicles": T.IntegerType(),
    "number_of_casualties": T.IntegerType(),
}


#: How cells are written: quotes are doubled, padding does not count, ``NA`` is null.
CELLS = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "nullValue": "NA",
}


def csv_schema(
    spark: SparkSession, path: str, types: dict[str, T.DataType]
) -> T.StructType:
    """Schema from the header line: the given types, text for every other column."""
    header = spark.read.csv(path, header=True, escape='"').columns
    return T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; padding is trimmed, ``NA`` and empty fields are null.

    Every file's header must name the columns of ``schema`` in order, else the read
    fails: cells never move to another column. Files are split across tasks whether or
    not cells hold line breaks. Integers are read as text first, so that ``3.0`` is a 3.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = _cells(spark, path, text)

    def typed(field: T.StructField) -> Column:
        col = F.nullif(cell(field.name), F.lit(""))
        if isinstance(field.dataType, T.IntegerType):
            col = to_int(col)
        elif not isinstance(field.dataType, T.StringType):
            col = col.try_cast(field.dataType)
        return col.alias(field.name)

    return df.select(*map(typed, schema))


def _cells(spark: SparkSession, path: str, text: T.StructType) -> DataFrame:
    """All cells as text."""
    found = records(spark, path)
    if found is None:
        return spark.read.schema(text).csv(path, header=True, enforceSchema=False, **CELLS)
    bare = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)"))
    found = found.withColumn("text", F.coalesce(bare, "text")).where(F.trim("text") != "")
    names = [f"_{i}" for i in range(len(text))]
    # The last column takes what goes beyond the header.
    plain = ", ".join(f"{n} string" for n in [*names, "_more"])
    cells = F.from_csv("text", plain, CELLS | {"multiLine": "true"})
    header = F.transform(
        F.array(*[cells[n] for n in [*names, "_more"]]), lambda c: F.coalesce(c, F.lit("NA"))
    )
    expected = F.array(*map(F.lit, [*text.fieldNames(), "NA"]))
    differs = F.raise_error(F.concat(F.lit(f"{path}: header differs: "), F.col("text")))
    checked = F.when(F.col("first"), F.when(header == expected, False).otherwise(differs))
    rows = found.where(F.coalesce(checked, F.lit(True))).select(cells.alias("_c"))
    return rows.select(
        *[F.col("_c")[n].alias(f.name) for n, f in zip(names, text, strict=True)]
    )


def write_csv(df: DataFrame, path: str, null: str = "NA") -> None:
    """Folder of CSV parts with headers; null is written as ``null``."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        escape='"',
        nullValue=null,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_table(
    spark: SparkSession,
    path: str,
    types: dict[str, T.DataType] = RAW_TYPES,
    guess: bool = False,
) -> DataFrame:
    """A ``.csv`` file or folder by name, Parquet otherwise.

    Columns of a CSV table that ``types`` does not list are text, or, with ``guess``, what
    all of their cells can be read as.
    """
    if not path.rstrip("/").endswith(".csv"):
        return spark.read.parquet(path)
    df = read_csv(spark, path, csv_schema(spark, path, types))
    if guess:
        return retyped(df, guessed(df, [c for c in df.columns if c not in types]))
    return df


def write_table(df: DataFrame, path: str, null: str = "NA") -> None:
    if path.rstrip("/").endswith(".csv"):
        write_csv(df, path, null)
    else:
        df.write.mode("overwrite").parquet(path)
