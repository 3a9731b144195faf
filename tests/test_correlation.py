import random

import brute
import pytest

from collidera.operators import counts
from collidera.operators.correlation import lower_triangle, matrix, spearman


@pytest.fixture(params=["one range", "many ranges"])
def way(request, spark):
    """Ranks from one range of values, and from as many as there are partitions."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, str(request.param == "one range").lower())
    yield request.param
    spark.conf.unset(merge)


def sample(seed, rows=300):
    rng = random.Random(seed)
    out = []
    for _ in range(rows):
        x = rng.randrange(20)
        y = 7 if rng.random() < 0.4 else x + rng.randrange(10)
        z = round(rng.gauss(0, 1), 2)
        out.append([None if rng.random() < 0.1 else v for v in (x, y, z)])
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_pairwise(spark, way, seed):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "x int, y int, z double")
    got = {(r.var1, r.var2): r for r in lower_triangle(df, ["x", "y", "z"]).collect()}
    place = {"x": 0, "y": 1, "z": 2}
    assert len(got) == 3
    for (a, b), r in got.items():
        left, right = [row[place[a]] for row in rows], [row[place[b]] for row in rows]
        want = brute.spearman(left, right)
        assert r.correlation == pytest.approx(want)
        assert r.label == pytest.approx(round(want, 1))
        assert r.n == sum(u is not None and v is not None for u, v in zip(left, right))


def test_everything_needs_complete_columns(spark, way):
    rows = [(1, 2, 3), (2, 3, 1), (3, 5, None), (4, 4, 0)]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    got = {
        (r.var1, r.var2): r.correlation
        for r in spearman(df, [("x", "y"), ("x", "z")], "everything").collect()
    }
    assert got[("x", "y")] == pytest.approx(0.8)
    assert got[("x", "z")] is None


def test_degenerate_columns(spark, way):
    rows = [(1, 5, None), (2, 5, None), (3, 5, 4)]
    df = spark.createDataFrame(rows, "x int, constant int, sparse int")
    pairs = [("x", "constant"), ("x", "sparse"), ("constant", "sparse")]
    got = spearman(df, pairs).collect()
    assert sorted((r.var1, r.var2, r.n, r.correlation) for r in got) == [
        ("constant", "sparse", 1, None),
        ("x", "constant", 3, None),
        ("x", "sparse", 1, None),
    ]
    empty = spark.createDataFrame([(1, None)], "x int, y int")
    assert [tuple(r) for r in spearman(empty, [("x", "y")]).collect()] == [("x", "y", 0, None)]


def test_matrix_is_symmetric_with_a_unit_diagonal(spark):
    df = spark.createDataFrame([(1, 4, 2), (2, 5, 1), (3, 5, 3)], "x int, y int, n int")
    got = {(r.var1, r.var2): r.correlation for r in matrix(df, ["x", "y"], "n").collect()}
    want = brute.spearman([1, 1, 2, 3, 3, 3], [4, 4, 5, 5, 5, 5])
    assert got[("x", "x")] == got[("y", "y")] == 1.0
    assert got[("x", "y")] == got[("y", "x")] == pytest.approx(want)


def test_unchanged_by_a_monotone_map(spark):
    rows = [r for r in sample(5) if None not in r]
    df = spark.createDataFrame(rows, "x int, y int, z double")
    mapped = df.selectExpr("exp(x) as x", "y * 3 + 1 as y")
    pair = [("x", "y")]
    r = spearman(df, pair).first().correlation
    assert -1 <= r <= 1
    assert spearman(mapped, pair).first().correlation == pytest.approx(r)


def test_unknown_null_rule(spark):
    with pytest.raises(ValueError):
        spearman(spark.range(1), [("id", "id")], "some")
