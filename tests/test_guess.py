"""Types guessed from all cells."""

import datetime

import pytest
from pyspark.sql import types as T

from collidera.sources import tables
from collidera.sources.guess import guess_types, guessed, retyped


@pytest.mark.parametrize(
    "kind,cells",
    [
        ("int", ["1", "-20", "+3", "0", None]),
        ("bigint", ["1", "3000000000"]),
        ("double", ["1", "3000000000", "1.5", ".5", "1e3", "2."]),
        ("double", ["123456789012345678901"]),
        ("time", ["17:30", "8:05", "23:59:59"]),
        ("date", ["2024-02-29", "1999-12-31"]),
        ("string", ["2024-02-29", "2023-02-29"]),
        ("string", ["17:30", "24:00"]),
        ("string", ["1", "01"]),
        ("string", ["1", "17:30"]),
        ("string", ["1d"]),
        ("string", ["NaN", "Infinity"]),
        ("string", [" 1"]),
        ("string", [""]),
        ("string", [None, None]),
        ("string", ["01/02/2024"]),
        ("string", ["true"]),
        ("string", ["1_000", "1,5"]),
    ],
)
def test_narrowest_type(spark, kind, cells):
    df = spark.createDataFrame([(c,) for c in cells], "`a.b` string").repartition(3)
    [row] = guess_types(df).collect()
    assert tuple(row) == (1, "a.b", kind, sum(c is not None for c in cells))


def test_only_text_columns_in_one_aggregate(spark):
    df = spark.createDataFrame([("1", 2, "x"), (None, 3, "17:00")], "a string, b int, c string")
    assert [tuple(r) for r in guess_types(df).collect()] == [(1, "a", "int", 1), (3, "c", "string", 2)]
    plan = guess_types(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Window" not in plan
    assert guess_types(df, ["b"]).collect() == []
    assert [tuple(r) for r in guess_types(df.limit(0)).collect()] == [(1, "a", "string", 0), (3, "c", "string", 0)]


def test_reading_with_guessed_types(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('n,time,day,x,note,speed_limit\n1,17:30,2024-01-02,NA,"a\nb",30.0\n2,,2024-03-04,1.5,01,40\n')
    df = tables.read_table(spark, str(path), {"speed_limit": T.IntegerType()}, guess=True)
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "date", "double", "string", "int"]
    day = datetime.date
    assert sorted(map(tuple, df.collect())) == [
        (1, "17:30", day(2024, 1, 2), None, "a\nb", 30),
        (2, None, day(2024, 3, 4), 1.5, "01", 40),
    ]
    text = spark.createDataFrame([("7",)], "k string")
    assert retyped(text, guessed(text)).first().k == 7
