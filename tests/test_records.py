"""CSV records over line breaks, cut from many byte ranges."""

import csv
import io
import random

import pytest

from collidera.sources import records, tables


@pytest.fixture(params=[None, 64, 200, 3000])
def ranges(request, spark):
    """The whole file as one byte range, and ranges of so many bytes."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return str(path)


def made_up(seed, n):
    rng = random.Random(seed)
    parts = ["a", "é", ",", '"', "\n", "\r\n", "b b", "two\nlines", '""', "x" * 30, "\n\n", '",\n"']
    return [
        (str(i), "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 9]))) + "z", str(rng.randint(0, 99)))
        for i in range(n)
    ]


def cells_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_several_files(spark, tmp_path, ranges, end):
    folder = tmp_path / "raw.csv"
    folder.mkdir()
    want = []
    for k in range(3):
        rows = made_up(k, 60)
        want += rows
        written(folder / f"{k}.csv", [("id", "note", "n"), *rows], end)
    df = tables.read_table(spark, str(folder), {})
    if ranges:
        assert df.rdd.getNumPartitions() > 3
    assert cells_of(df) == sorted(want)


def test_a_cell_as_long_as_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(f"line {i}" for i in range(800))
    rows = [("1", long), ("2", "short"), ("3", long + '"\n"'), ("4", "end\n.")]
    path = written(tmp_path / "raw.csv", [("id", "note"), *rows])
    assert cells_of(tables.read_table(spark, path, {})) == sorted(rows)


def test_a_header_over_lines_and_blank_lines(spark, tmp_path, ranges):
    path = tmp_path / "raw.csv"
    path.write_text('id,note\n\n1,"a\nb"\n   \n2,c\n\n')
    df = tables.read_table(spark, str(path), {})
    assert cells_of(df) == [("1", "a\nb"), ("2", "c")]
    path.write_text('"id","no te"\n1,"a\nb"')
    assert tables.read_table(spark, str(path), {}).columns == ["id", "no te"]


def test_a_differing_header_and_an_open_quote_fail(spark, tmp_path):
    folder = tmp_path / "raw.csv"
    folder.mkdir()
    written(folder / "a.csv", [("id", "note"), ("1", "a\nb")])
    written(folder / "b.csv", [("note", "id"), ("a\nb", "1")])
    with pytest.raises(Exception, match="header differs"):
        tables.read_table(spark, str(folder), {}).collect()
    more = tmp_path / "more.csv"
    more.mkdir()
    written(more / "a.csv", [("id", "note"), ("1", "a\nb")])
    written(more / "b.csv", [("id", "note", "third"), ("1", "a\nb", "2")])
    with pytest.raises(Exception, match="header differs"):
        tables.read_table(spark, str(more), {}).collect()
    bad = tmp_path / "bad.csv"
    bad.write_text('id,note\n1,"open\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        tables.read_table(spark, str(bad), {})


def test_files_without_line_breaks_stay_in_the_jvm(spark, tmp_path):
    path = written(tmp_path / "raw.csv", [("id", "note"), ("1", 'say "hi", then'), ("2", "")])
    assert records.records(spark, path) is None
    df = tables.read_table(spark, path, {})
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert cells_of(df.fillna("-")) == [("1", 'say "hi", then'), ("2", "-")]


def test_only_pieces_are_shuffled(spark, tmp_path, ranges):
    """Whole records stay in the task that reads them."""
    path = written(tmp_path / "raw.csv", [("id", "note", "n"), *made_up(9, 300)])
    plan = tables.read_table(spark, path, {})._jdf.queryExecution().executedPlan().toString()
    text = plan[plan.index("MapInArrow") :]
    assert "Exchange hashpartitioning" not in text.split("Scan parquet")[0].split("FileScan text")[0]
    assert plan.count("MapInArrow") == 1
