"""Fingerprints, vectors and components against plain code."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from collidera.llm import embedding_dedup as ed
from collidera.llm import simhash as sh
from collidera.llm.components import components
from collidera.llm.session import importable
from collidera.llm.skew import lookup

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


def plain_roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, shape):
    rng = np.random.default_rng(4)
    links = {
        "random": [tuple(map(int, x)) for x in rng.integers(0, 300, (200, 2))],
        "path": [(i, i + 1) for i in rng.permutation(64).tolist()],
        "star": [(0, i) for i in range(1, 200)] + [(5, 5), (1, 0)],
        "empty": [],
    }[shape]
    table = spark.createDataFrame([*links, *links[:3], (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(table).collect()}
    want = plain_roots({x for link in links for x in link}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_lookup_serves_hot_and_rare_keys(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, -1, id % 20000) AS k")
    per_key = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("low"))
    got = lookup(rows, per_key, "k", 30_000)
    want = rows.join(per_key.drop("_n"), "k")
    assert got.count() == 30_000 and got.exceptAll(want.select(got.columns)).isEmpty()


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in ["", " \n", "One", "A b C", "Ä É straße Ü x y", "a b c d e f a b c d e f", "q r s\x1ct u v w x"]:
        assert sh.fingerprint(text) % 2**64 == plain_fingerprint(text)
    hashed = spark.createDataFrame([("w x y z",)], "t string").select(F.xxhash64("t")).first()[0]
    assert sh.fingerprint("W X  Y\nZ") == hashed


@pytest.mark.parametrize("radius,segments", [(4, 3), (4, 4), (3, 2), (2, 4)])
def test_close_pairs_lose_none(spark, radius, segments):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    found = set(base.tolist())
    for x in base.tolist():
        for k in range(1, 7):
            y = x
            for b in rng.choice(64, k, replace=False).tolist():
                y ^= 1 << b
            found.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in found]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.a, r.b) for r in sh.close_pairs(table, radius, segments).collect()}
    want = {
        (min(a, b), max(a, b))
        for a, b in itertools.combinations(signed, 2)
        if ((a ^ b) % 2**64).bit_count() <= radius
    }
    assert got == want and want


def test_simhash_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: plain_fingerprint(t) for d, t in list(texts.items())}
    ids = sorted(prints)
    links = [
        (a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    roots = plain_roots(ids, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.simhash_dedup(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", roots[d]) for d in ids}


def test_simhash_on_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (1, "", 2), (None, "a b c d e", 3), (7, "A B C D E", 4), (9, "z " * 99_999, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in sh.simhash_dedup(table).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (None, 7), (7, 7), (9, 9)], key=str)
    assert sh.simhash_dedup(table.limit(0)).count() == 0


def test_simhash_chain_over_a_document_without_id(spark):
    """Its fingerprint is a node like any other."""
    table = spark.createDataFrame([(0, 0b0, 5), (1, 0b1111, None), (2, 0b11111111, 7)], "k int, fp long, doc_id long")
    prints = table.select("doc_id", "fp")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sh, "fingerprints", lambda _: prints)
        for segments in (None, 2):
            got = {r.fp: r.component_id for r in sh.simhash_groups(table, 4, segments).collect()}
            assert got == {0b0: 5, 0b1111: 5, 0b11111111: 5}
        patch.setattr(sh, "fingerprints", lambda _: prints.where("doc_id is null"))
        assert [r.component_id for r in sh.simhash_groups(table).collect()] == [None]
    assert sh.segments_for(10**6) == 3 and sh.segments_for(10**8) == 2


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 48)) * rng.choice([1, 1, 30], (400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, length, error = ed.quantised(x)
    near = (q * scale[:, None]) @ (q * scale[:, None]).T
    bound = length[:, None] * error[None, :] + error[:, None]
    assert (np.abs(x @ x.T - near) <= bound + 1e-12).all()


def test_vectors_against_plain_code(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(size=16) * s for c in centre for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25)]
    vectors += [3 * centre[0], centre[1], centre[1]]
    rows = [(i, [float(np.float32(v)) for v in x], 1) for i, x in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None], 0), (n + 4, [], 0), (n + 5, [1.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)]
    roots = plain_roots(range(n), links)
    for block in (8192, 50):
        got = {r.vec_id: r for r in ed.embedding_dedup(table, block=block).collect()}
        assert len(got) == len(rows)
        extra = linked[0] + 0
        extra[0] = 1
        for i in range(n):
            assert got[i].n_links == linked[i].sum() + extra[i]
            assert got[i].component_id == roots[i] and got[i].kept == (roots[i] == i)
        for i in range(n, n + 6):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[None].component_id == 0 and not got[None].kept
    assert ed.embedding_dedup(table.limit(0)).count() == 0


def links_of(spark, rows, block):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(((tuple(r)) for r in ed.embedding_dedup(table, block=block).collect()), key=str)


def plain_links(rows):
    """Links of rows, counted pair by pair."""
    def cosine(a, b):
        return np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)

    n = len(rows)
    pairs = [
        (i, j) for i, j in itertools.combinations(range(n), 2)
        if len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.95
    ]
    roots = plain_roots(range(n), pairs)
    found = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if roots[j] == roots[i] and rows[j][0] is not None]
        component = min(ids, default=None)
        links = sum(i in p for p in pairs)
        kept = vec_id is not None and vec_id == component
        found.append((vec_id, links, component, kept))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [3, 40, 4096])
def test_rare_lengths_and_empty_blocks(spark, block):
    """Of some lengths only one of two blocks has vectors."""
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for k in range(10):
        x = rng.normal(size=20 + k)
        rows += [(200 + 2 * k, x.tolist()), (201 + 2 * k, (x + 0.01).tolist())]
    assert links_of(spark, rows, block) == plain_links(rows)


@pytest.mark.parametrize("block", [2, 4096])
def test_repeated_and_missing_ids(spark, block):
    """An id of two vectors, and a chain over a vector without id."""
    turn = [[np.cos(a), np.sin(a)] for a in (0.0, 0.3, 0.6, 2.0, 2.1, 4.0)]
    rows = list(zip([5, None, 7, 9, 3, 9], [list(map(float, t)) for t in turn], strict=True))
    rows += [(None, rows[5][1]), (None, [-1.0, 0.3]), (11, rows[0][1])]
    assert links_of(spark, rows, block) == plain_links(rows)
