"""Code columns to labels.

A code book row says that in column ``field_name`` the text ``code`` means
``label``. Decoding replaces every cell whose text is a listed code; other cells
keep their text, nulls stay null, and a column without usable code rows is left
alone. When a code is listed twice the row first in source order counts.

How a column is decoded follows from the measured size of its dictionary:

* up to ``MAP_CODES`` codes, and ``MAP_BYTES`` for all of them together: such columns
  share one broadcast row that holds a map per column. A map is searched entry by
  entry, so this is for short dictionaries;
* up to ``BROADCAST_BYTES`` for all of them together: broadcast hash joins;
* beyond: the distinct codes of the table are counted, of all such columns in one pass,
  and each dictionary is reduced to the codes that occur. What fits the byte limit now is
  broadcast. The other columns share a single lookup: their cells become rows of row
  number, column and code, take one join with the reduced dictionaries, and come back by
  row number, so whole rows move once, however many columns there are.

Codes that fill a large part of the table would pile up in one task of that lookup. The
counts tell them; they are served from a broadcast, which their share bounds.

That lookup broadcasts nothing else: left to Spark, joins go by the compressed size of
settled files, of which cells and labels are a large multiple. So they ask for a merge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.functions.cells import all_present, as_text, cell
from collidera.operators.attach import attach
from collidera.sources.shared_folder import settled

MAP_CODES = 64
MAP_BYTES = 1 << 20
BROADCAST_BYTES = 64 << 20
# A code held by more than 1 / HOT_SHARES of the rows is served by broadcast.
HOT_SHARES = 1000


@dataclass(frozen=True)
class CodeBook:
    """Usable code rows, the size of each field's dictionary, and the map row."""

    usable: DataFrame
    rows: dict[str, int]
    bytes: dict[str, int]
    by_map: list[str]
    maps: DataFrame

    def of(self, field: str) -> DataFrame:
        """``(code, label)`` of one field, unique by code; the first row counts."""
        return (
            self.usable.where(F.col("field_name") == field)
            .groupBy("code")
            .agg(F.min_by("label", "_place").alias("label"))
        )


def guide_columns(guide: DataFrame) -> DataFrame:
    """Code book with plain column names, as text."""
    renamed = guide.withColumnsRenamed({"field name": "field_name", "code/format": "code"})
    return renamed.withColumns(
        {name: as_text(renamed, name) for name in ("table", "field_name", "code", "label")}
    )


def code_book(
    guide: DataFrame, columns: list[str], table: str = "collision", map_codes: int = MAP_CODES
) -> CodeBook:
    """Usable rows of ``table`` for the columns a data table has.

    The code book is read once; one row per column comes back with its sizes.
    """
    place = F.struct(*[c for c in ("path", "row_idx") if c in guide.columns])
    usable = settled(
        guide_columns(guide)
        .where(F.col("table") == table)
        .where(F.col("field_name").isin(*columns))
        .where(all_present("code", "label"))
        .select("field_name", "code", "label", place.alias("_place"))
    ).table
    codes = usable.groupBy("field_name", "code").agg(F.min_by("label", "_place").alias("label"))
    size = F.sum(F.octet_length("code") + F.octet_length("label"))
    sizes = codes.groupBy("field_name").agg(F.count("*").alias("rows"), size.alias("bytes"))
    measured = {s.field_name: s for s in sizes.collect()}
    by_map, room = [], MAP_BYTES
    for field, s in sorted(measured.items(), key=lambda item: (item[1].bytes, item[0])):
        room -= s.bytes
        if room >= 0 and s.rows <= map_codes:
            by_map.append(field)

    def code_map(field: str) -> Column:
        entry = F.when(F.col("field_name") == field, F.struct("code", "label"))
        return F.map_from_entries(F.collect_list(entry)).alias(f"_map_{field}")

    short = codes.where(F.col("field_name").isin(*by_map))
    maps = settled(short.agg(F.count("*").alias("_codes"), *map(code_map, by_map))).table
    return CodeBook(
        usable,
        {f: s.rows for f, s in measured.items()},
        {f: s.bytes for f, s in measured.items()},
        by_map,
        maps.drop("_codes"),
    )


def decode(df: DataFrame, book: CodeBook, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Decode every column that has usable code rows."""
    fields = [c for c in df.columns if c in book.rows]
    out = decode_by_map(df, book, [c for c in fields if c in book.by_map])
    others = sorted(set(fields) - set(book.by_map), key=lambda f: (book.bytes[f], f))
    small, large, room = within(others, book.bytes, broadcast_bytes)
    for field in small:
        out = _joined(out, field, book.of(field))
    return decode_large(out, book, large, room)


def within(
    fields: list[str], sizes: dict[str, int], room: int
) -> tuple[list[str], list[str], int]:
    """Fields that fit into ``room`` bytes one after the other, the rest, and what is left."""
    small, large = [], []
    for field in fields:
        fits = sizes[field] <= room
        (small if fits else large).append(field)
        room -= sizes[field] if fits else 0
    return small, large, room


def decode_by_map(df: DataFrame, book: CodeBook, fields: list[str]) -> DataFrame:
    """Decode columns from one broadcast row with a code map per column."""
    if not fields:
        return df

    def label(field: str) -> Column:
        text = as_text(df, field)
        return F.coalesce(F.try_element_at(F.col(f"_map_{field}"), text), text)

    return (
        attach(df, book.maps)
        .withColumns({field: label(field) for field in fields})
        .select(*map(cell, df.columns))
    )


def decode_by_join(
    df: DataFrame, book: CodeBook, field: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Decode one column by joining its dictionary."""
    if book.bytes[field] > broadcast_bytes:
        return decode_large(df, book, [field], broadcast_bytes)
    return _joined(df, field, book.of(field))


def _joined(df: DataFrame, field: str, codes: DataFrame) -> DataFrame:
    """A column decoded from a broadcast of ``(code, label)``, one row per code."""
    codes = codes.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    text = as_text(df, field)
    joined = df.join(F.broadcast(codes), text == F.col("_code"), "left")
    return joined.withColumn(field, F.coalesce("_label", text)).select(*map(cell, df.columns))


def occurring(df: DataFrame, book: CodeBook, fields: list[str]) -> DataFrame:
    """``(field, code, label, n)``: the codes in the cells of ``fields``, from one scan.

    ``label`` is null where the code book does not list the code; null cells are left out.
    """
    counted = (
        df.select(F.inline(_cells(df, fields)))
        .where(F.col("code").isNotNull())
        .groupBy("field", "code")
        .agg(F.count("*").alias("n"))
    )
    listed = (
        book.usable.where(F.col("field_name").isin(*fields))
        .groupBy(F.col("field_name").alias("field"), "code")
        .agg(F.min_by("label", "_place").alias("label"))
    )
    return settled(counted.join(listed.hint("merge"), ["field", "code"], "left")).table


def _cells(df: DataFrame, fields: list[str]) -> Column:
    """The cells of some columns as an array of ``(field, code)``."""
    return F.array(
        *[F.struct(F.lit(f).alias("field"), as_text(df, f).alias("code")) for f in fields]
    )


def decode_large(df: DataFrame, book: CodeBook, fields: list[str], room: int) -> DataFrame:
    """Decode columns whose dictionaries together exceed ``room`` bytes.

    Dictionaries are reduced to the codes that occur; those within ``room`` are broadcast,
    the others are looked up together.
    """
    if not fields:
        return df
    codes = occurring(df, book, fields)
    listed = codes.where(F.col("label").isNotNull())
    size = F.sum(F.octet_length("code") + F.octet_length("label"))
    measured = listed.groupBy("field").agg(size.alias("bytes")).collect()
    sizes = dict.fromkeys(fields, 0) | {r["field"]: r["bytes"] for r in measured}
    ordered = sorted(fields, key=lambda f: (sizes[f], f))
    small, large, _ = within(ordered, sizes, room)
    out = df
    for field in small:
        out = _joined(out, field, listed.where(F.col("field") == field))
    return decode_together(out, codes, large)


def decode_together(df: DataFrame, codes: DataFrame, fields: list[str]) -> DataFrame:
    """Decode columns by one join of all their cells and one of whole rows.

    ``codes`` is what ``occurring`` tells of them. Rows are numbered once, when they are
    settled, so that a repeated task meets the same numbers.
    """
    if not fields:
        return df
    row = "_row"
    while row in df.columns:
        row += "_"
    kept = settled(df.withColumn(row, F.monotonically_increasing_id()))
    cells = kept.table.select(cell(row).alias("row"), F.inline(_cells(df, fields)))
    # Fewer than HOT_SHARES codes of a column can be hot, listed or not.
    is_hot = F.col("n") * HOT_SHARES > kept.rows
    hot = F.broadcast(codes.where(is_hot).select("field", "code", "label"))
    rare = codes.where(~is_hot & F.col("label").isNotNull()).select("field", "code", "label")
    key = ["field", "code"]
    served = cells.join(hot.where(F.col("label").isNotNull()), key)
    others = cells.where(F.col("code").isNotNull()).join(hot, key, "left_anti")
    others = others.join(rare.hint("merge"), key)
    labels = [f"_label{i}" for i in range(len(fields))]
    per_row = served.unionByName(others).groupBy("row").agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("label"))).alias(label)
            for f, label in zip(fields, labels, strict=True)
        ]
    )
    whole = kept.table.join(per_row.hint("merge"), cell(row) == F.col("row"), "left")
    decoded = {
        f: F.coalesce(F.col(label), as_text(df, f)) for f, label in zip(fields, labels, strict=True)
    }
    return whole.withColumns(decoded).select(*map(cell, df.columns))
