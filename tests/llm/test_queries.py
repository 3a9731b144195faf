"""Registered queries against their SQL, and the shape of all of them."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from collidera.llm import queries

SF_DIR = "/root/testdata/sf0.001"
ORACLES = queries.oracle_sql()


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert bag(got.columns, got.collect()) == bag(names, want.fetchall())


def test_one_query_for_each_operator():
    numbers = [n.split("_")[0] for n in queries.queries() if n.startswith("op")]
    assert sorted(numbers, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 14)]
