import datetime

from pyspark.sql import functions as F

from collidera.functions.cells import as_text, hour_of, member, parse_day_first_date, to_int
from collidera.functions.levels import (
    SEVERITIES,
    WEEKDAYS,
    coded_levels,
    first_match,
    in_level_order,
    level_ordinal,
    level_value,
    weekend_flag,
)
from collidera.functions.numbers import log10_count, percent, round_even


def column(spark, values, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression(df)).collect()]


def test_dates(spark):
    texts = [
        "01/02/2024",
        "1/3/2024",
        "31/02/2024",
        "01/02/2024 xx",
        " 05/06/2024",
        "2024-01-02",
        "",
        None,
    ]
    got = column(spark, texts, "string", lambda df: parse_day_first_date(F.col("x")))
    day = datetime.date
    assert got == [
        day(2024, 2, 1),
        day(2024, 3, 1),
        None,
        day(2024, 2, 1),
        day(2024, 6, 5),
        None,
        None,
        None,
    ]


def test_hours(spark):
    texts = ["17:30", "9:05", "00:00", "24:00", "1730", "ab:10", "", None]
    got = column(spark, texts, "string", lambda df: hour_of(F.col("x")))
    assert got == [17, 9, 0, None, None, None, None, None]


def test_text_of_numbers(spark):
    doubles = [30.0, 0.5, -1.0, 123456789012.0, 1e300, float("nan"), float("inf"), None]
    got = column(spark, doubles, "double", lambda df: as_text(df, "x"))
    assert got == ["30", "0.5", "-1", "123456789012", "1.0E300", "NaN", "Infinity", None]
    assert column(spark, [7, None], "int", lambda df: as_text(df, "x")) == ["7", None]


def test_to_int(spark):
    got = column(spark, ["30", " 40 ", "fast", "", None], "string", lambda df: to_int(F.col("x")))
    assert got == [30, 40, None, None, None]


def test_membership_is_never_null(spark):
    got = column(spark, ["a", "b", None], "string", lambda df: member(F.col("x"), ["a"]))
    assert got == [True, False, False]


def test_levels(spark):
    days = ["Monday", "Sunday", "Funday", None]
    x = F.col("x")
    assert column(spark, days, "string", lambda df: level_ordinal(x, WEEKDAYS)) == [1, 7, None, None]
    assert column(spark, days, "string", lambda df: level_value(x, WEEKDAYS)) == [
        "Monday",
        "Sunday",
        None,
        None,
    ]
    assert column(spark, days, "string", lambda df: weekend_flag(x)) == [
        "weekday",
        "weekend",
        "weekday",
        "weekday",
    ]


def test_first_match(spark):
    cases = coded_levels(SEVERITIES)
    got = column(
        spark,
        ["1", "Serious", "3", "4", None],
        "string",
        lambda df: first_match(F.col("x"), cases, "Unknown"),
    )
    assert got == ["Fatal", "Serious", "Slight", "Unknown", "Unknown"]
    numbers = column(
        spark, [2.0, 9.0], "double", lambda df: first_match(as_text(df, "x"), cases, "Unknown")
    )
    assert numbers == ["Serious", "Unknown"]


def test_numbers(spark):
    x = F.col("x")
    assert column(spark, [0.125, 0.375, -0.125], "double", lambda df: round_even(x, 2)) == [
        0.12,
        0.38,
        -0.12,
    ]
    assert column(spark, [0, 1, 100], "bigint", lambda df: log10_count(x)) == [None, 0.0, 2.0]
    assert column(spark, [3], "bigint", lambda df: percent(x, F.lit(12))) == [25.0]
    assert column(spark, [3], "bigint", lambda df: percent(x, F.lit(0))) == [None]


def test_level_order(spark):
    df = spark.createDataFrame(
        [(None, 1, 0.1), ("Sunday", 2, 0.2), ("Monday", None, 0.3), ("Monday", 9, 0.4)],
        "day_of_week string, hour int, share double",
    )
    assert [(r.day_of_week, r.hour) for r in in_level_order(df).collect()] == [
        ("Monday", 9),
        ("Monday", None),
        ("Sunday", 2),
        (None, 1),
    ]
