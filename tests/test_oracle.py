"""Every registered query against its SQL counterpart."""

import math
import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(comparable(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    """Those of the optional subpackage are held to other tests where SQL cannot say them."""
    without = sorted(set(QUERIES) - set(ORACLES))
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", name) for name in without)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    got_rows = bag(got.columns, got.collect())
    want_rows = bag(names, want.fetchall())
    assert sum(got_rows.values()) == sum(want_rows.values())
    assert got_rows == want_rows
    assert got_rows
