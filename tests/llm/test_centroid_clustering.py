"""Clustering over zone maps against plain rounds over all vectors."""

import hashlib
import itertools

import numpy as np
import pytest

from collidera.llm import centroid_clustering as cc
from collidera.llm.session import importable


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


def plain(rows, p):
    """Rounds in Python integers; rows are ``(vec_id, components)``."""
    kept = [
        (i, [int(np.floor(p.scale * float(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == p.dim and all(x is not None and np.isfinite(x) for x in v)
    ]

    def place(row):
        i, v = row
        return (i is None, hashlib.sha256(f"{p.seed}:{i}".encode()).hexdigest(), v)

    centroids = [v for _, v in sorted(kept, key=place)[: p.clusters]]

    def best(v):
        distances = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return min(distances), distances.index(min(distances))

    for _ in range(p.rounds if kept else 0):
        own = [best(v)[1] for _, v in kept]
        for k in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            centroids[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *best(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, o in found if o == k) for _, _, k in found}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, inertia[k], sum(inertia.values()), names[k]) for i, d, k in found]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_curve_visits_neighbours():
    """Along the curve every step changes one coordinate by one, and no cell is left out."""
    for dims, bits in ((2, 4), (3, 3), (5, 2), (12, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = cc.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("size", [1 << 10, 1 << 26])
def test_candidates_never_lose_the_nearest(size):
    rng = np.random.default_rng(size)
    pruned = 0
    for _ in range(300):
        centre = rng.integers(-size, size, 6)
        v = centre + rng.integers(-size // 8, size // 8 + 1, (20, 6))
        centroids = rng.integers(-size, size, (9, 6))
        centroids[4] = centroids[2]
        distance = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for x in v])
        able = cc.candidates(v.min(0), v.max(0), centroids)
        own, found = cc.nearest(v, centroids[able])
        assert (able[own] == distance.argmin(1)).all() and (found == distance.min(1)).all()
        pruned += 9 - len(able)
    assert pruned > 300


def test_rounds(spark):
    """Hot vectors, ties, empty clusters, odd rows; many small blocks and one large one."""
    rng = np.random.default_rng(12)
    p = cc.Clustering(clusters=5, rounds=4, dim=6, block=16, curve_dims=4, curve_bits=3)
    centre = rng.normal(size=(4, 6))
    rows = [(i, (centre[i % 4] + rng.normal(size=6) / 9).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)] + [(7, rows[7][1])] * 3
    rows += [(None, [0.25] * 6), (None, [-0.25] * 6), (2000, None), (2001, [1.0] * 5), (2002, [1.0] * 7)]
    rows += [(2003, [float("nan")] + [0.0] * 5), (2004, [float("inf")] + [0.0] * 5), (2005, [None] + [0.0] * 5)]
    rows += [(2006, [0.0] * 6), (2007, [-1e-9] * 6), (2008, [])]
    df = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, cluster string"
    )
    want = sorted(plain(rows, p), key=str)
    assert rows_of(cc.centroid_clustering(df, p)) == want
    one = cc.Clustering(clusters=5, rounds=4, dim=6, block=10_000, curve_dims=1, curve_bits=1)
    assert rows_of(cc.centroid_clustering(df.coalesce(1), one)) == want


def test_doubles_on_a_wide_grid(spark):
    p = cc.Clustering(clusters=3, rounds=3, dim=2, block=8)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=2) * 30_000).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert rows_of(cc.centroid_clustering(df, p)) == sorted(plain(rows, p), key=str)
    far = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="a component is"):
        cc.centroid_clustering(far, p).collect()


def test_fewer_vectors_than_clusters_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    p = cc.Clustering(dim=2)
    rows = [(2, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])]
    got = cc.centroid_clustering(spark.createDataFrame(rows, schema), p)
    assert rows_of(got) == sorted(plain(rows, p), key=str)
    for none in ([], [(1, None)]):
        empty = cc.centroid_clustering(spark.createDataFrame(none, schema), p)
        assert empty.collect() == [] and empty.columns == got.columns


def test_boxes_spare_comparisons(spark):
    """Where vectors lie in groups, most blocks meet a few centroids only; copies meet one."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(30, 64))
    rows = [(i, (centre[i % 30] + rng.normal(size=64) / 50).tolist()) for i in range(3000)]
    rows += [(5000 + i, centre[0].tolist()) for i in range(1500)]
    p = cc.Clustering(block=32)
    grid = cc.on_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p)
    blocks, first = cc.zone_maps(grid, p), cc.seeds(grid, p)
    boxes = blocks.select("low", "high").collect()
    able = [
        len(cc.candidates(*(np.frombuffer(x, "<i4").astype(np.int64) for x in r), first))
        for r in boxes
    ]
    assert sum(able) < 4 * len(able)
    hot = blocks.where("low = high").selectExpr("sum(size(ids))").first()[0]
    assert hot > 1000 and blocks.selectExpr("max(size(ids))").first()[0] <= 32
