import random

import brute
import numpy as np
import pytest

from collidera.operators import counts
from collidera.operators.box import box_outliers, box_stats
from collidera.operators.density import density, ridges, violins
from collidera.operators.histogram import histogram


@pytest.fixture(params=["one range", "many ranges"])
def way(request, spark):
    """Ranks from one range of values, and from as many as there are partitions."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, str(request.param == "one range").lower())
    yield request.param
    spark.conf.unset(merge)


def sample(seed, rows=300):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", None]), None if rng.random() < 0.05 else round(rng.gauss(12, 6), 1))
        for _ in range(rows)
    ]


def groups_of(rows):
    out = {}
    for g, x in rows:
        out.setdefault(g, [])
        if x is not None:
            out[g].append(x)
    return out


def curves_of(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        out.setdefault(r.g, []).append(tuple(r[c] for c in columns))
    return {g: np.array(points).T for g, points in out.items()}


# ---- histograms


def test_unit_bins_are_centred_and_right_closed(spark):
    values = [2.5, 2.500001, 3.5, 7.0, None, 2.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sorted((r.bin, r.xmin, r.xmax, r.n, r.log_n) for r in histogram(df, "x", width=1).collect())
    assert [g[3] for g in got] == brute.bins(values, [2.5, 3.5, 4.5, 5.5, 6.5, 7.5]) == [4, 0, 0, 0, 1]
    assert got[0][1:3] == (2.5, 3.5) and got[-1][1:3] == (6.5, 7.5)
    assert got[1][4] is None and got[4][4] == 0.0


def test_integers_fall_on_bin_centres(spark):
    df = spark.createDataFrame([(0,), (23,), (5,), (5,)], "x int")
    got = {r.x: r.n for r in histogram(df, "x", width=1).collect()}
    assert len(got) == 24 and got[0.0] == 1 and got[5.0] == 2 and got[23.0] == 1


def test_counted_bins_share_one_layout(spark):
    rows = [("u", 20), ("u", 30), ("u", 30), ("r", 70), ("r", None), (None, 40)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = histogram(df, "x", ["g"], bins=15).collect()
    width = 50 / 14
    breaks = [20 + (k - 0.5) * width for k in range(16)]
    assert len(got) == 45
    for g in ("u", "r", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.bin)
        assert [r.n for r in mine] == brute.bins([x for h, x in rows if h == g], breaks)
        assert [r.xmin for r in mine] == pytest.approx(breaks[:-1])


def test_border_values_belong_to_the_lower_bin(spark):
    df = spark.createDataFrame([(v / 2,) for v in range(29)], "x double")
    got = {r.bin: r.n for r in histogram(df, "x", bins=15).collect()}
    breaks = [k - 0.5 for k in range(16)]
    assert [got[k] for k in range(15)] == brute.bins([v / 2 for v in range(29)], breaks)


def test_single_value_has_one_narrow_bin(spark):
    df = spark.createDataFrame([(30,), (30,)], "x int")
    (r,) = histogram(df, "x", bins=15).collect()
    assert r.n == 2 and r.xmin == pytest.approx(29.95) and r.xmax == pytest.approx(30.05)


def test_many_bins_and_no_rows(spark):
    df = spark.createDataFrame([(0,), (10_000,)], "x int")
    got = histogram(df, "x", width=1)
    assert got.count() == 10_001 and got.where("n > 0").count() == 2
    assert histogram(df.where("x < 0"), "x", width=1).count() == 0
    with pytest.raises(ValueError):
        histogram(df, "x")


# ---- densities


@pytest.mark.parametrize("seed", [6])
def test_joint_range_density(spark, way, seed):
    rows = sample(seed) + [("lone", 90.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = groups_of(rows)
    lo, hi = min(map(min, groups.values())), 90.0
    got = curves_of(density(df, "x", ["g"]), "x", "density")
    assert set(got) == {"a", "b", None}
    for g, (x, d) in got.items():
        assert x == pytest.approx(np.linspace(lo, hi, 512))
        want = brute.kde(groups[g], brute.bandwidth(groups[g]), x)
        assert d == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_ridges(spark, way):
    rows = sample(7) + [("two", 1.0), ("two", 9.0), ("lone", 50.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = groups_of(rows)
    bw = np.mean([brute.bandwidth(v) for g, v in groups.items() if len(v) >= 2])
    got = curves_of(ridges(df, "x", ["g"]), "x", "density", "height")
    assert set(got) == {"a", "b", None}
    lo = min(map(min, groups.values())) - 3 * bw
    want = {g: brute.kde(groups[g], bw, np.linspace(lo, 50 + 3 * bw, 512)) for g in got}
    peak = max(map(max, want.values()))
    for g, (x, d, h) in got.items():
        assert (x[0], x[-1]) == pytest.approx((lo, 50 + 3 * bw))
        assert d == pytest.approx(want[g], rel=1e-9, abs=1e-300)
        assert h == pytest.approx(want[g] / peak, rel=1e-9, abs=1e-300)
        step = (x[-1] - x[0]) / 511
        assert d.sum() * step == pytest.approx(1, abs=0.01)


def test_violins_over_their_own_range(spark, way):
    rows = sample(8) + [("flat", 4.0)] * 5 + [("zero", 0.0)] * 3 + [("lone", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = groups_of(rows)
    got = curves_of(violins(df, "x", ["g"]), "x", "density", "width")
    assert set(got) == {"a", "b", None, "flat", "zero"}
    grids = {g: np.linspace(min(groups[g]), max(groups[g]), 512) for g in got}
    want = {g: brute.kde(groups[g], brute.bandwidth(groups[g]), grids[g]) for g in got}
    peak = max(map(max, want.values()))
    for g, (x, d, w) in got.items():
        assert x == pytest.approx(grids[g])
        assert d == pytest.approx(want[g], rel=1e-9)
        assert w == pytest.approx(want[g] / peak, rel=1e-9)


def test_bandwidth_without_quartile_range(spark, way):
    """More than half of the values equal: the deviation takes over."""
    rows = [("a", 1.0)] * 8 + [("a", 3.0)] * 2
    df = spark.createDataFrame(rows, "g string, x double")
    ((x, d),) = curves_of(density(df, "x", ["g"]), "x", "density").values()
    values = [v for _, v in rows]
    bw = 0.9 * np.std(values, ddof=1) * 10**-0.2
    assert brute.bandwidth(values) == pytest.approx(bw)
    assert d == pytest.approx(brute.kde(values, bw, x), rel=1e-9)


def test_far_values_lie_outside_the_kernel(spark):
    """A narrow curve on a wide grid: the points it does not reach are still there."""
    rows = [("a", float(v)) for v in range(30)] + [("b", 1e6), ("b", 1e6 + 1)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = curves_of(density(df, "x", ["g"]), "x", "density")
    for g, values in groups_of(rows).items():
        x, d = got[g]
        assert len(x) == 512
        want = brute.kde(values, brute.bandwidth(values), x)
        assert d == pytest.approx(want, rel=1e-9, abs=1e-300)


# ---- boxes


def test_boxes(spark, way):
    groups = {
        "plain": [1, 2, 3, 4, 5],
        "equal": [2] * 6,
        "both sides": [-50, 1, 2, 2, 3, 3, 4, 60, 60],
        None: [1, 1, 1, 2, 9, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, x int")
    got = {r.g: r for r in box_stats(df, "x", ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        r = got[g]
        want = brute.box(values)
        assert (r.ymin, r.lower, r.middle, r.upper, r.ymax, r.n_outliers) == pytest.approx(want)
        assert r.n == len(brute.present(values))
    outliers = {(r.g, r.x, r.n) for r in box_outliers(df, "x", ["g"]).collect()}
    assert outliers == {("both sides", -50.0, 1), ("both sides", 60.0, 2), (None, 9.0, 1)}


# ---- names


def test_columns_may_have_any_name(spark):
    """Columns named as the operators name theirs, or with a dot, give the same rows."""
    rows = [(("a", "b")[k % 2], float(k * k % 17), 1 + k % 3) for k in range(40)]
    plain = spark.createDataFrame(rows, "g string, x double, m int")

    def rows_of(df):
        return sorted((tuple(map(str, r)) for r in df.collect()))

    for group, value, weight in [("i", "n", "v"), ("v", "i", "n"), ("a.b", "c.d", "x.y"), ("n", "v", "i")]:
        odd = spark.createDataFrame(rows, f"`{group}` string, `{value}` double, `{weight}` int")
        for operator in (box_stats, box_outliers, density, ridges, violins):
            want = rows_of(operator(plain, "x", ["g"], weight="m"))
            got = operator(odd, value, [group], weight=weight)
            assert got.columns[0] == group and len(set(got.columns)) == len(got.columns)
            assert rows_of(got) == want
        want = rows_of(histogram(plain, "x", ["g"], bins=5, weight="m"))
        assert rows_of(histogram(odd, value, [group], bins=5, weight=weight)) == want


def test_curves_move_no_more_than_their_points(spark):
    """No row per pair of grid points: the kernel is folded inside arrays."""
    df = spark.range(2000).selectExpr("id % 7 as g", "cast(id % 301 as double) as x")
    plan = density(df, "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 0 and plan.count("Generate inline") == 2
