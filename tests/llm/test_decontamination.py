"""Suffix array search against plain counting of windows."""

import hashlib
import random
import re

import pytest

from collidera.llm import decontamination as dc
from collidera.llm.session import importable

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def plain(texts, items, window):
    """``(n_words, n_hit, item ids)`` of each text."""
    windows = {}
    for item_id, text in items:
        words = plain_words(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[k : k + m]), set()).add(item_id)
    found = []
    for text in texts:
        words, hit, ids = plain_words(text), set(), set()
        for m in {len(w) for w in windows}:
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in windows:
                    ids |= windows[tuple(words[k : k + m])]
                    hit.update(range(k, k + m))
        found.append((len(words), len(hit), ids))
    return found


def plain_longest(texts, items, window):
    found = {}
    for item_id, text in items:
        item, best = plain_words(text), 0
        for words in map(plain_words, texts):
            for a in range(len(item)):
                for b in range(len(words)):
                    k = 0
                    while a + k < len(item) and b + k < len(words) and item[a + k] == words[b + k]:
                        k += 1
                    best = max(best, k)
        if item and best >= min(window, len(item)):
            found[item_id] = max(found.get(item_id, 0), best)
    return found


def made_up(rng, vocabulary):
    size = rng.choice
    items = [(i, " ".join(rng.choices(vocabulary, k=size([0, 1, 2, 9, 10, 30])))) for i in range(6)]
    items += [(0, "A, b! c"), (None, "q q q"), (7, None)]
    texts = [" ".join(rng.choices([*vocabulary, "ZZ"], k=size([0, 1, 8, 40]))) for _ in range(10)]
    for _, text in items:
        texts.append(f"x {(text or '').upper()} . y {(text or '')[len(text or '') // 3 :]}")
    return texts, items


@pytest.mark.parametrize("distinct", [1, 2, 26, 3000])
@pytest.mark.parametrize("window", [3, 10])
def test_matches_of_shards(distinct, window):
    rng = random.Random(distinct + window)
    vocabulary = [chr(97 + i) for i in range(26)][:distinct]
    vocabulary += [f"É{i}" for i in range(distinct - 26)]
    for size in (1, 100, 10**6):
        texts, items = made_up(rng, vocabulary)
        index = dc.Benchmark([(i, (t or "").encode()) for i, t in items], window)
        got = [
            row
            for part in dc.shards([t.encode() for t in texts], size)
            for row in dc.matches(part, index, window)
        ]
        flat = [(n, sum(b - a for a, b in spans), ids) for n, spans, ids, _ in got]
        assert flat == plain(texts, items, window)
        best = {}
        for _, _, _, longest in got:
            for item_id, _, _, length in longest:
                best[item_id] = max(best.get(item_id, 0), length)
        assert best == plain_longest(texts, items, window)


def test_suffixes_are_sorted_to_the_depth_asked_for():
    rng = random.Random(5)
    words = [rng.randint(0, 3) for _ in range(400)] + [1, 2] * 100
    import numpy as np

    array = dc.SuffixArray(np.array(words), 4, 3, 50)

    def key(place):
        found = words[place : place + 50]
        return found[: found.index(0)] if 0 in found else found

    keys = [key(p) for p in array.order.tolist()]
    assert keys == sorted(keys) and len(keys) == sum(w > 0 for w in words)


def test_merged_spans():
    assert dc.merged([(5, 7), (0, 2), (2, 3), (6, 9), (6, 7)]) == [(0, 3), (5, 9)]


def digest(ids):
    return hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_odd_rows_in_one_or_many_blocks(spark, block_bytes):
    """Nulls, empties, repeats, clashing names; small blocks cut the items into many passes."""
    long = " ".join(f"t{i}" for i in range(60))
    items = [(1, long), (1, "one two"), (2, long), (None, "lost id here"), (3, None), (4, " -- "), (5, "Straße")]
    texts = [
        None, "", "...", f"a {long} b", f"{long} {long}".upper(), "ONE, two.", "the lost id here", "straße", "STRASSE",
        " ".join(long.split()[20:29]), " ".join(long.split()[20:30]),
    ]
    rows = [(i if i % 4 else None, t, f"n{i}", i) for i, t in enumerate([*texts, *texts[3:5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, item_id int")
    bench = spark.createDataFrame(
        [(i, t, 1) for i, t in items], "item_id long, text string, _part int"
    )
    search = dc.Search(block_bytes=block_bytes)
    want = [
        (d, n, hit, len(ids - {None}), digest(ids), hit > 0)
        for (d, *_), (n, hit, ids) in zip(rows, plain([r[1] for r in rows], items, 10), strict=True)
    ]
    got = [tuple(r) for r in dc.decontamination(docs, bench, search).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = dc.decontaminated(docs, bench, search)
    assert clean.schema == docs.schema
    kept = [r for r, w in zip(rows, want, strict=True) if not w[-1]]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted(kept, key=str)
    longest = {r.item_id: r.length for r in dc.longest_matches(docs, bench, search).collect()}
    assert longest == {1: 60, 2: 60, None: 3, 5: 1}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id string, text string")
    none = dc.decontamination(docs, bench.limit(0)).collect()
    assert [tuple(r) for r in none] == [(1, 3, 0, 0, digest([]), False)]
    assert dc.decontamination(docs.limit(0), bench).collect() == []
    assert dc.decontamination(docs, bench).first()["n_hit"] == 3
    assert dc.longest_matches(docs.limit(0), bench).collect() == []


def test_many_copies_and_repeating_words(spark):
    """Periodic texts make every place a window; work and output stay with the text."""
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('a ', 2000) AS text")
    bench = spark.createDataFrame([(k, "a " * 500) for k in range(20)], "item_id long, text string")
    got = dc.decontamination(docs, bench).distinct().groupBy("n_hit", "n_items").count().collect()
    assert [tuple(r) for r in got] == [(2000, 20, 200)]
