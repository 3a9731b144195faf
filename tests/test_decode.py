import pytest

from collidera.operators import decode as module
from collidera.operators.decode import code_book, decode, decode_by_join, occurring

GUIDE = "table string, `field name` string, `code/format` string, label string, row_idx int"


def guide(spark, rows):
    numbered = [(*row, i) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, GUIDE)


ROWS = [
    ("vehicle", "severity", "1", "wrong table"),
    ("collision", "severity", "1", "Fatal"),
    ("collision", "severity", "3", "Slight"),
    ("collision", "severity", "3", "second entry"),
    ("collision", "severity", "4", None),
    ("collision", "format_only", None, "(HH:MM)"),
    ("collision", "not_in_table", "1", "x"),
    ("collision", "Severity", "1", "other case"),
    ("collision", "speed", "30", "thirty"),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [
            (1, "1", 5, 30.0, "a"),
            (2, "3", 6, 30.5, "b"),
            (3, "4", 7, None, "c"),
            (4, "9", 8, -1.0, "d"),
            (5, None, 9, 30.0, None),
        ],
        "id int, severity string, format_only int, speed double, other string",
    )


WANT = [
    (1, "Fatal", 5, "thirty", "a"),
    (2, "Slight", 6, "30.5", "b"),
    (3, "4", 7, None, "c"),
    (4, "9", 8, "-1", "d"),
    (5, None, 9, "thirty", None),
]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("map_codes", [64, 0])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_rules(spark, table, map_codes, broadcast_bytes):
    book = code_book(guide(spark, ROWS), table.columns, map_codes=map_codes)
    assert book.rows == {"severity": 2, "speed": 1}
    out = decode(table, book, broadcast_bytes)
    assert out.columns == table.columns
    assert dict(out.dtypes)["format_only"] == "int"
    assert dict(out.dtypes)["speed"] == "string"
    assert rows_of(out) == WANT


def test_empty_code_book_changes_nothing(spark, table):
    book = code_book(guide(spark, []), table.columns)
    out = decode(table, book)
    assert out.schema == table.schema
    assert rows_of(out) == rows_of(table)


def test_decoding_twice_is_decoding_once(spark, table):
    book = code_book(guide(spark, ROWS), table.columns)
    once = decode(table, book)
    assert rows_of(decode(once, book)) == rows_of(once)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcasts(spark):
    """Joins without a hint take the way that they take on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_codes_are_kept_apart_in_a_shuffled_lookup(spark, without_broadcasts):
    """A third of the rows share a code, a third an unlisted one, a third of the rest none."""
    codes = [("collision", "district", str(k), f"D{k}") for k in range(2000)]
    df = spark.range(9000).selectExpr(
        "id",
        "case when id % 3 = 0 then '7' when id % 3 = 1 then 'x' when id % 9 = 2 then null"
        " else cast(id % 3000 as string) end as district",
    )
    book = code_book(guide(spark, codes), df.columns)
    shuffled = decode_by_join(df, book, "district", broadcast_bytes=0)
    broadcast = decode_by_join(df, book, "district")
    assert rows_of(shuffled.fillna("null")) == rows_of(broadcast.fillna("null"))
    assert shuffled.where("district = 'D7'").count() == 3000
    assert shuffled.where("district = 'x'").count() == 3000
    assert shuffled.where("district is null").count() == 1000
    known = occurring(df, book, ["district"])
    assert known.where("code = 'x' and label is null and n = 3000").count() == 1
    plan = plan_of(shuffled)
    assert "LeftAnti, BuildRight" in plan and plan.count("SortMergeJoin") == 2


@pytest.mark.parametrize("k", [1, 2, 4])
def test_large_dictionaries_move_whole_rows_once(spark, tmp_path, without_broadcasts, k):
    """One exchange of the table and one of all cells, however many columns there are."""
    fields = ["a", "b", "c", "d"][:k]
    path = str(tmp_path / "rows.parquet")
    spark.range(6000).selectExpr(
        "id", "id as _row", "repeat('w', 50) as wide",
        *[f"if(id % 3 = 0, '7', if(id % 3 = 1, null, cast(id % {97 + i} as string))) {f}" for i, f in enumerate(fields)],
    ).write.parquet(path)
    df = spark.read.parquet(path)
    codes = [("collision", f, str(c), f"{f}{c}") for f in fields for c in range(100)]
    book = code_book(guide(spark, codes), df.columns, map_codes=0)
    out = decode(df, book, broadcast_bytes=0)
    exchanges = [x for x in plan_of(out).splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in exchanges if "(_row_#" in x]) == 1
    assert len([x for x in exchanges if "(field#" in x]) == 2
    assert len([x for x in exchanges if "(row#" in x]) == 1 and len(exchanges) == 4
    assert out.columns == df.columns
    assert rows_of(out.fillna("-")) == rows_of(decode(df, book).fillna("-"))


def test_dictionaries_are_reduced_to_the_codes_that_occur(spark, without_broadcasts):
    """A dictionary far over the limit is broadcast where few of its codes occur."""
    df = spark.range(3000).selectExpr("id", "cast(id % 50 as string) a", "cast(id as string) b")
    rows = spark.range(40_000).selectExpr(
        "'collision' table", "if(id % 2 = 0, 'a', 'b') `field name`",
        "cast(floor(id / 2) as string) `code/format`", "'label ' || id label", "cast(id as int) row_idx",
    )
    book = code_book(rows, df.columns)
    assert book.bytes["a"] > 100_000 and book.rows["a"] == 20_000
    out = decode(df, book, broadcast_bytes=100_000)
    plan = plan_of(out)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert "Exchange hashpartitioning" not in plan
    # Of what is left one dictionary fits, the other one does not.
    mixed = decode(df, book, broadcast_bytes=10_000)
    assert plan_of(mixed).count("SortMergeJoin") == 2
    for found in (out, mixed):
        assert rows_of(found) == rows_of(decode(df, book))


def test_only_hot_codes_are_broadcast_in_the_lookup(spark, monkeypatch):
    """Neither cells nor dictionaries, however small their files let Spark take them for."""
    settled, plans = module.settled, []

    def seen(df):
        plans.append(plan_of(df))
        return settled(df)

    df = spark.range(3000).selectExpr("id", "cast(id as string) a", "if(id % 2 = 0, '3', 'x') b")
    codes = [("collision", f, str(c), f"{f}{c}") for f in "ab" for c in range(0, 2000, 3)]
    book = code_book(guide(spark, codes), df.columns, map_codes=0)
    monkeypatch.setattr(module, "settled", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = decode(df, book, broadcast_bytes=0)
        before, found = plan_of(out), rows_of(out)
        after = plan_of(out).partition("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    counts, kept = plans
    assert counts.count("SortMergeJoin") == 1 and "Broadcast" not in counts
    assert "Join" not in kept
    for plan in (before, after):
        assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 2
    assert "isFinalPlan=true" in after
    assert found == rows_of(decode(df, book))


def test_dotted_columns_pass_through(spark):
    df = spark.createDataFrame([("1", 2, "x")], "severity string, `a.b` int, `c``d` string")
    for broadcast_bytes in (1 << 20, 0):
        book = code_book(guide(spark, ROWS), df.columns, map_codes=0)
        assert tuple(decode(df, book, broadcast_bytes).first()) == ("Fatal", 2, "x")
    book = code_book(guide(spark, ROWS), df.columns)
    assert tuple(decode(df, book).first()) == ("Fatal", 2, "x")
