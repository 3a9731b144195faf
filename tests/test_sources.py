import io
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.operators.decode import code_book
from collidera.operators.structure import structure
from collidera.plans import prepare
from collidera.plans.prepare import clean_step, read_code_book
import fixtures
from collidera.sources import shared_folder, tables, workbook


def write(path, text):
    Path(path).write_text(text)
    return str(path)


def test_csv_reading(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        "collision_index,time,number_of_vehicles,note\n"
        'a,17:30,2,"one, two"\n'
        'NA,  08:05 ,NA,"say ""hi"""\n'
        ",,,\n"
        'b,09:00,x,""\n',
    )
    schema = tables.csv_schema(spark, path, tables.RAW_TYPES)
    assert [f.dataType for f in schema] == [
        T.StringType(),
        T.StringType(),
        T.IntegerType(),
        T.StringType(),
    ]
    assert [tuple(r) for r in tables.read_csv(spark, path, schema).collect()] == [
        ("a", "17:30", 2, "one, two"),
        (None, "08:05", None, 'say "hi"'),
        (None, None, None, None),
        ("b", "09:00", None, None),
    ]


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "raw.csv", 'a,b\n1,"two\nlines"\n')
    schema = tables.csv_schema(spark, path, {})
    assert tables.read_csv(spark, path, schema).first().b == "two\nlines"


def test_a_differing_header_fails(spark, tmp_path):
    folder = tmp_path / "raw.csv"
    folder.mkdir()
    write(folder / "a.csv", "speed_limit,time\n30,10:00\n")
    write(folder / "b.csv", "time,speed_limit\n11:00,40\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, str(folder)).collect()


def test_numbers_however_they_are_spelled(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "number_of_vehicles,x\n3.0,1\n2,2\n 4 ,3\n3.5,4\nmany,5\n")
    rows = tables.read_table(spark, path).orderBy("x").collect()
    assert [r.number_of_vehicles for r in rows] == [3, 2, 4, None, None]


@pytest.mark.parametrize("text", ["one\ntwo", "a\r\nb", 'say "hi",\n\nthen', "x\\ny", '"'])
def test_cells_with_line_breaks_survive_the_hand_offs(spark, tmp_path, text):
    df = spark.createDataFrame([(text, "30.0"), ("plain", "40")], "note string, speed_limit string")
    raw, out = str(tmp_path / "decoded.csv"), str(tmp_path / "cleaned.csv")
    tables.write_table(df, raw, null="")
    clean_step(spark, raw, out)
    back = tables.read_table(spark, out, tables.CLEANED_TYPES)
    assert sorted(map(tuple, back.collect())) == sorted([(text, 30), ("plain", 40)])


def test_cleaning_reads_the_table_once(spark, tmp_path, monkeypatch):
    """Rows and nulls are counted while the cleaned table is written."""
    rows = [("Unknown", "30", None), ("x", None, "01/02/2024"), ("y", "50", "31/02/2024")] * 50
    df = spark.createDataFrame(rows, "note string, speed_limit string, date string")
    decoded, out = str(tmp_path / "decoded"), str(tmp_path / "cleaned")
    tables.write_table(df, decoded)
    passed = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counting(_):
        passed.add(1)
        return True

    def reading(spark, path, *types):
        table = tables.read_table(spark, path, *types)
        return table.where(counting(F.rand(1))) if path == decoded else table

    monkeypatch.setattr(prepare, "read_table", reading)
    preview, nulls = clean_step(spark, decoded, out)
    assert sorted(map(tuple, nulls.collect())) == [("date", 100), ("note", 50), ("speed_limit", 50)]
    found = {r.column: r for r in preview.collect()}
    assert {r.n_rows for r in found.values()} == {150} and found["date"].type == "date"
    assert found["note"].first_values.count(",") == 4
    assert passed.value == 150


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_code_books_without_row_numbers(spark, tmp_path, kind):
    path = str(tmp_path / f"guide.{kind}")
    rows = [("collision", "severity", "1", "first"), ("collision", "severity", "1", "second")]
    df = spark.createDataFrame(rows, "table string, `field name` string, `code/format` string, label string")
    tables.write_table(df.coalesce(1), path)
    book = code_book(read_code_book(spark, path), ["severity"])
    assert book.of("severity").first().label == "first"


def test_first_row_wins_over_several_workbooks(spark):
    rows = [("b.xlsx", 1, "late"), ("a.xlsx", 2, "later"), ("a.xlsx", 1, "first"), ("c.xlsx", 1, "last")]
    guide = spark.createDataFrame(
        [(p, i, "collision", "severity", "1", x) for p, i, x in rows],
        "path string, row_idx int, table string, `field name` string, `code/format` string, label string",
    )
    assert code_book(guide, ["severity"]).of("severity").first().label == "first"


@pytest.mark.parametrize("null", ["", "NA"])
def test_csv_round_trip(spark, tmp_path, null):
    rows = [("a,b", 1), ('say "hi"', None), (None, 3), ("x\\y", 4)]
    df = spark.createDataFrame(rows, "s string, k int").coalesce(1)
    path = str(tmp_path / "out.csv")
    tables.write_table(df, path, null)
    back = tables.read_table(spark, path, {"k": T.IntegerType()})
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    (part,) = Path(path).glob("part-*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == "s,k" and f"{null},3" in lines


def test_parquet_round_trip(spark, tmp_path):
    df = spark.range(5)
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 5


def sheet(rows):
    return f'<worksheet xmlns="{fixtures.MAIN}"><sheetData>{rows}</sheetData></worksheet>'


def make_workbook(path, first, second, shared):
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{fixtures.MAIN}" xmlns:r="{fixtures.RELATIONS}"><sheets>'
        '<sheet name="one" sheetId="4" r:id="rId9"/><sheet name="two" sheetId="1" r:id="rId1"/>'
        "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{fixtures.PACKAGE}">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId9" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{fixtures.MAIN}">{shared}</sst>',
        "xl/worksheets/sheet1.xml": sheet(second),
        "xl/worksheets/sheet2.xml": sheet(first),
    }
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)


def test_workbook_cells(spark, tmp_path):
    shared = (
        "<si><t>table</t></si><si><t>field name</t></si>"
        "<si><r><t>code/</t></r><r><t>format</t></r><rPh sb='0' eb='1'><t>aid</t></rPh></si>"
        "<si><t> label </t></si><si><t>collision</t></si>"
    )
    first = (
        '<row r="1"/>'
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c>'
        '<c r="C2" t="s"><v>2</v></c><c r="D2" t="s"><v>3</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>4</v></c><c r="B3" t="inlineStr"><is><t>day</t></is></c>'
        '<c r="C3"><v>1</v></c><c r="D3" t="str"><v>Sunday</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>4</v></c><c r="C4" t="b"><v>1</v></c>'
        '<c r="D4" t="e"><v>#N/A</v></c></row>'
        '<row r="5"><c r="A5" t="s"><v>4</v></c></row>'
    )
    make_workbook(tmp_path / "guide.xlsx", first, '<row><c><v>9</v></c></row>', shared)
    rows = workbook.read_guide(workbook.workbook_files(spark, str(tmp_path / "guide.xlsx"))).orderBy("row_idx").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (1, "collision", "day", "1", "Sunday"),
        (2, "collision", None, "TRUE", None),
        (3, "collision", None, None, None),
    ]


def test_several_workbooks_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "BATCH", 2)
    header = "<row>" + "".join(
        f'<c t="inlineStr"><is><t>{name}</t></is></c>'
        for name in ("label", "table", "field name", "code/format")
    ) + "</row>"
    for k in range(3):
        body = "".join(
            f'<row><c><v>{i}</v></c><c t="inlineStr"><is><t>book{k}</t></is></c></row>' for i in range(5)
        )
        make_workbook(tmp_path / f"g{k}.xlsx", header + body, "", "")
    got = workbook.read_guide(workbook.workbook_files(spark, str(tmp_path))).collect()
    assert sorted((r.table, r.row_idx, r.label, r["field name"]) for r in got) == [
        (f"book{k}", i + 1, str(i), None) for k in range(3) for i in range(5)
    ]


def test_guide_workbook_equals_guide_table(spark):
    path = shared_folder.new_path(spark, "guide.xlsx")
    shared_folder.put_bytes(spark, path, fixtures.guide_workbook())
    columns = ["table", "field name", "code/format", "label"]
    read = workbook.read_guide(workbook.workbook_files(spark, path)).orderBy("row_idx").select(columns).collect()
    assert read == fixtures.guide_table(spark).orderBy("row_idx").select(columns).collect()
    assert zipfile.is_zipfile(io.BytesIO(fixtures.guide_workbook()))


def test_settled_tables_are_counted_and_kept(spark):
    kept = shared_folder.settled(spark.range(7).selectExpr("id", "rand() as x"))
    assert kept.rows == 7
    assert sorted(kept.table.collect()) == sorted(kept.table.collect())
    assert shared_folder.settled(spark.range(0)).rows == 0
    assert shared_folder.new_path(spark, "a") != shared_folder.new_path(spark, "a")


def test_structure(spark):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "k int, s string")
    assert [tuple(r) for r in structure(df, first=2).collect()] == [
        (1, "k", "int", "1, 2", 3),
        (2, "s", "string", "NA, b", 3),
    ]


def test_released_folders_are_gone(spark):
    before = shared_folder.settled(spark.range(3)).table
    with shared_folder.released(spark):
        inside = shared_folder.settled(spark.range(4)).table
        paths = inside.inputFiles()
        assert paths and all(Path(p.removeprefix("file://")).exists() for p in paths)
    assert not any(Path(p.removeprefix("file://")).exists() for p in paths)
    assert before.count() == 3
