"""Fixture of the registered queries and tests: a collision-shaped view over the ``events`` table, and a code book for it."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DISTRICTS = 300

# XML namespaces of the workbook format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"

# Fixed values: (table, field, code, label), in source order.
GUIDE_ROWS = [
    ("vehicle", "collision_severity", "1", "Not a collision label"),
    ("collision", "collision_severity", "1", "Fatal"),
    ("collision", "collision_severity", "2", "Serious"),
    ("collision", "collision_severity", "3", "Slight"),
    ("collision", "collision_severity", "3", "Slight, listed again"),
    ("collision", "urban_or_rural_area", "1", "Urban"),
    ("collision", "urban_or_rural_area", "2", "Rural"),
    ("collision", "urban_or_rural_area", "3", "Unallocated"),
    ("collision", "day_of_week", "1", "Sunday"),
    ("collision", "day_of_week", "2", "Monday"),
    ("collision", "day_of_week", "3", "Tuesday"),
    ("collision", "day_of_week", "4", "Wednesday"),
    ("collision", "day_of_week", "5", "Thursday"),
    ("collision", "day_of_week", "6", "Friday"),
    ("collision", "day_of_week", "7", "Saturday"),
    ("collision", "junction_detail", "0", "Not at junction or within 20 metres"),
    ("collision", "junction_detail", "13", "T or staggered junction"),
    ("collision", "junction_detail", "99", "unknown (self reported)"),
    ("collision", "junction_detail", "16", None),
    ("collision", "speed_limit", "-1", "Data missing or out of range"),
    ("collision", "date", None, "(DD/MM/YYYY)"),
]


def guide_rows() -> list[tuple[str, str, str | None, str | None]]:
    """All code book rows: the fixed ones and one per district."""
    districts = [
        ("collision", "local_authority_district", str(k), f"District {k}") for k in range(DISTRICTS)
    ]
    return GUIDE_ROWS + districts


def guide_table(spark: SparkSession) -> DataFrame:
    """The code book as a table, under the column names of its source."""
    rows = [(*row, i) for i, row in enumerate(guide_rows())]
    return spark.createDataFrame(
        rows, "table string, `field name` string, `code/format` string, label string, row_idx int"
    )


def large_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code book with a row for each order and customer, for two columns of the view."""
    order = "'Order of ' || cast(o_orderdate as date) || ', customer ' || o_custkey"
    parts = {
        "orders": ("collision_ref_no", "o_orderkey", order),
        "customer": ("local_authority_highway_current", "'E' || c_custkey", "c_name || ' in ' || c_mktsegment"),
    }
    rows = [
        spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(
            "'collision' as table",
            f"'{field}' as `field name`",
            f"cast({code} as string) as `code/format`",
            f"{label} as label",
            "0 as row_idx",
        )
        for name, (field, code, label) in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(guide_table(spark))


# Text columns of the view, as expressions over an event.
VIEW = {
    "collision_index": "event_id",
    "collision_ref_no": "event_id",
    "local_authority_highway_current": "concat('E', user_id)",
    "local_authority_district": f"user_id % {DISTRICTS}",
    "date": "if(event_id % 97 = 0, '31/02/2024', date_format(ts, 'dd/MM/yyyy'))",
    "time": "if(event_id % 89 = 0, null, date_format(ts, 'HH:mm'))",
    "day_of_week": "if(event_id % 71 = 0, null, dayofweek(ts))",
    "collision_severity": (
        "case when event_id % 83 = 0 then null when event_type = 'error' then 1"
        " when event_type = 'purchase' then 2 else 3 end"
    ),
    "enhanced_severity_collision": (
        "case event_id % 5 when 0 then -1 when 1 then 1 when 2 then 2 else 3 end"
    ),
    "junction_detail": "case event_id % 4 when 0 then 0 when 1 then 19 when 2 then 13 else 99 end",
    "urban_or_rural_area": "1 + user_id % 3",
    "speed_limit": (
        "case event_id % 9 when 0 then -1 when 1 then 20 when 5 then 40 when 6 then 50"
        " when 7 then 60 when 8 then 70 else 30 end"
    ),
}


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collision per event, with invalid dates, missing cells and sentinels."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "2024 as collision_year",
        *[f"cast({expression} as string) as {name}" for name, expression in VIEW.items()],
        "cast(1 + event_id % 4 as int) as number_of_vehicles",
        "cast(1 + floor(value / 60) as int) as number_of_casualties",
    )


def as_written(df: DataFrame) -> DataFrame:
    """Every column as the text that a file would have, and columns of a few more kinds."""
    texts = df.select(*[F.col(c).cast("string") for c in df.columns])
    return texts.selectExpr(
        "*",
        "speed_limit || '.5' as half_limit",
        "concat_ws('-', substring(date, 7, 4), substring(date, 4, 2), '05') as month",
        "'0' || collision_ref_no as padded",
        "collision_ref_no || '00000000' as large",
        "cast(null as string) as empty",
    )


def guide_workbook() -> bytes:
    """The code book as the first sheet of a workbook."""
    header = ("table", "field name", "code/format", "label")
    rows = "".join(
        "<row>"
        + "".join(
            f'<c r="{letter}{i}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
            for letter, text in zip("ABCD", row)
            if text is not None
        )
        + "</row>"
        for i, row in enumerate([header, *guide_rows()], start=1)
    )
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>'
        '<sheet name="guide" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{rows}'
        "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()
