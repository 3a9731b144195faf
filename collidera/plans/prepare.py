"""From raw table and code book to cleaned table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from collidera.functions.cells import cell
from collidera.operators.clean import clean
from collidera.operators.cube import Cube, cubed
from collidera.operators.decode import CodeBook, code_book, decode
from collidera.operators.structure import structure
from collidera.plans import areas, hours
from collidera.sources.tables import CLEANED_TYPES, RAW_TYPES, read_table, write_table
from collidera.sources.workbook import read_guide, workbook_files

def prepared(df: DataFrame, book: CodeBook) -> DataFrame:
    """Decoded and cleaned in one plan, without a table in between."""
    return clean(decode(df, book))


def read_code_book(spark: SparkSession, path: str) -> DataFrame:
    """Code book rows from ``.xlsx`` or ``.csv`` files, or from a Parquet table.

    Rows keep their order: that of a sheet, or of the rows as they are read.
    """
    if path.endswith(".xlsx"):
        return read_guide(workbook_files(spark, path))
    rows = read_table(spark, path, {})
    if "row_idx" in rows.columns:
        return rows.withColumn("row_idx", F.col("row_idx").cast("bigint"))
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def decode_step(spark: SparkSession, raw: str, guide: str, out: str) -> None:
    """Decode the raw table at ``raw`` with the code book at ``guide`` into ``out``."""
    df = read_table(spark, raw, RAW_TYPES)
    write_table(decode(df, code_book(read_code_book(spark, guide), df.columns)), out, null="")


def clean_step(spark: SparkSession, decoded: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Clean the decoded table at ``decoded`` into ``out``.

    Returns the structure of the cleaned table, with its first rows as they were written,
    and its null counts. Rows and nulls are counted while they are written; nothing but
    the first rows is read again.
    """
    cleaned = clean(read_table(spark, decoded, RAW_TYPES))
    seen = Observation()
    observed, counts = null_metrics(cleaned, seen)
    write_table(observed, out, null="NA")
    nulls, n_rows = counts()
    return structure(read_table(spark, out, CLEANED_TYPES), n_rows=n_rows), nulls


def null_metrics(
    df: DataFrame, seen: Observation
) -> tuple[DataFrame, Callable[[], tuple[DataFrame, int]]]:
    """``df`` that counts its rows and nulls as it is computed, and what it has counted.

    The second part gives ``(column, n_null)`` of the columns with nulls, and the number
    of rows, once the first one is written.
    """
    columns = df.columns
    nulls = [F.count_if(cell(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(columns)]
    observed = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *nulls)

    def counts() -> tuple[DataFrame, int]:
        rows = [(c, seen.get[f"nulls{i}"]) for i, c in enumerate(columns)]
        found = [(c, n) for c, n in rows if n]
        table = df.sparkSession.createDataFrame(found, "column string, n_null bigint")
        return table, seen.get["n_rows"]

    return observed, counts


def report_cube(
    cleaned: DataFrame, reports: Sequence[str], path: str | None = None
) -> dict[str, Cube]:
    """Counts that the tables of the named reports need, from one scan of the cleaned table."""
    features = cleaned
    sets: list[list[str]] = []
    for name in reports:
        features = REPORTS[name].add_features(features)
        sets += REPORTS[name].SETS
    whole = cubed(features, sets, path)
    return {name: REPORTS[name].of_cube(whole) for name in reports}


REPORTS = {"hours": hours, "areas": areas}
