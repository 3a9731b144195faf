"""Code books kept as the first sheet of an Excel workbook.

One input row is one workbook, so workbooks are unpacked in parallel. The file
format bounds a sheet to about a million rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# XML namespaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

BATCH = 10_000
ROWS_SCHEMA = "path string, row_idx int, names array<string>, cells array<string>"


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the workbooks at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_sheet_rows(files: DataFrame) -> DataFrame:
    """Rows below the header of the first sheet of every workbook of ``(path, content)``.

    ``names`` repeats the header; ``row_idx`` counts from 1 within the workbook.
    """
    return files.select("path", "content").mapInPandas(_unpack, ROWS_SCHEMA)


def read_guide(
    files: DataFrame,
    columns: tuple[str, ...] = ("table", "field name", "code/format", "label"),
) -> DataFrame:
    """Code book rows as text, with ``path`` and ``row_idx``, the row's place.

    Columns are found by the names in the first row of the workbook; a column it
    lacks is null.
    """

    def cell(name: str) -> Column:
        place = F.array_position("names", F.lit(name)).cast("int")
        return F.when(place > 0, F.get("cells", place - 1)).alias(name)

    return read_sheet_rows(files).select("path", "row_idx", *[cell(c) for c in columns])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _first_sheet(content)
            names = next(rows, [])
            numbered = enumerate(rows, start=1)
            while block := [(path, i, names, cells) for i, cells in islice(numbered, BATCH)]:
                yield pd.DataFrame(block, columns=["path", "row_idx", "names", "cells"])


def _first_sheet(content: bytes) -> Iterator[list[str | None]]:
    """Rows from the first non-empty one on, as trimmed text; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        seen_header = False
        with book.open(_first_sheet_part(book)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != f"{MAIN}row":
                    continue
                cells = _row_cells(node, shared)
                node.clear()
                seen_header = seen_header or any(c is not None for c in cells)
                if seen_header:
                    yield cells


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text(item) for item in root.iter(f"{MAIN}si")]


def _text(node: ElementTree.Element) -> str:
    """Text of a string item: its own and its formatted runs, no reading aids."""
    own = [t.text or "" for t in node.findall(f"{MAIN}t")]
    runs = [t.text or "" for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return "".join(own + runs)


def _first_sheet_part(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    target = targets[sheet.get(RELATION)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _row_cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    cells: list[str | None] = []
    for node in row.findall(f"{MAIN}c"):
        place = _column_index(node.get("r")) if node.get("r") else len(cells)
        cells += [None] * (place + 1 - len(cells))
        cells[place] = _cell_text(node, shared)
    return cells


def _column_index(reference: str) -> int:
    """0-based column of a cell reference such as ``AB12``."""
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        item = cell.find(f"{MAIN}is")
        text = _text(item) if item is not None else ""
    else:
        text = cell.findtext(f"{MAIN}v", default="")
        if kind == "s" and text:
            text = shared[int(text)]
        elif kind == "b" and text:
            text = "TRUE" if text == "1" else "FALSE"
        elif kind == "e":
            text = ""
    return text.strip() or None
