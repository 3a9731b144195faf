"""Sentinels to nulls, dates, column types, identifier columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import (
    as_text,
    blank_values,
    cell,
    parse_day_first_date,
    rejected,
    to_int,
)

# Labels and codes that stand for a missing entry.
SENTINELS = [
    "Unknown",
    "unknown (self reported)",
    "Data missing or out of range",
    "Unallocated",
]
MISSING_CODES = {"enhanced_severity_collision": "-1", "junction_detail": "19"}

# Columns no report uses.
IDENTIFIERS = [
    "collision_index",
    "collision_ref_no",
    "collision_year",
    "local_authority_highway_current",
    "local_authority_district",
]

# Columns that are numbers again once their sentinel labels are gone.
NUMERIC = ["speed_limit", "number_of_vehicles", "number_of_casualties"]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def blank_sentinels(df: DataFrame, sentinels: list[str] = SENTINELS) -> DataFrame:
    """Null for a sentinel, in text columns only."""
    values = F.array(*[F.lit(s) for s in sentinels])
    return df.withColumns({c: blank_values(cell(c), values) for c in text_columns(df)})


def blank_codes(df: DataFrame, codes: dict[str, str] = MISSING_CODES) -> DataFrame:
    """Null for one code per column, whatever the column's type."""
    return df.withColumns(
        {c: F.when(as_text(df, c) != code, cell(c)) for c, code in codes.items() if c in df.columns}
    )


def retype(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Text columns to integers; a label left among the numbers gives null."""
    return df.withColumns({c: to_int(cell(c)) for c in columns if c in text_columns(df)})


def rejected_numbers(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """One row: per numeric text column, how many cells ``retype`` would turn to null."""
    named = [c for c in columns if c in text_columns(df)]
    return df.agg(
        F.count("*").alias("n"), *[F.count_if(rejected(cell(c))).alias(c) for c in named]
    )


def drop_identifiers(df: DataFrame, columns: list[str] = IDENTIFIERS) -> DataFrame:
    return df.drop(*columns)


def clean(df: DataFrame) -> DataFrame:
    """Cleaned collision table, with the types the reports rely on."""
    out = blank_codes(blank_sentinels(df))
    if "enhanced_severity_collision" in out.columns:
        out = out.withColumn(
            "enhanced_severity_collision", as_text(out, "enhanced_severity_collision")
        )
    if "date" in text_columns(out):
        out = out.withColumn("date", parse_day_first_date(F.col("date")))
    return retype(drop_identifiers(out))
