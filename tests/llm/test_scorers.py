"""Trained scorers and line rules: formulas against plain code, accuracy, odd rows."""

import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from collidera.llm import language_id as li
from collidera.llm import quality_classifier as qc
from collidera.llm import quality_rules as qr
from collidera.llm import toxicity as tx
from collidera.llm.session import importable
from collidera.llm.terms import TermHashes, labelled_sample

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double, label int"
ODD = [
    (1, None, "en", "a", 0.5, 7),
    (2, "", "en", "a", None, None),
    (2, "", "en", "a", None, None),
    (None, "the quick brown fox the quick", None, None, 0.1, 1),
    (4, "x" * 200_000 + " " + "word " * 30_000, "en", "b", 0.1, 1),
    (5, "1234 5678 --- !!!", "de", "b", 0.1, 1),
]


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def area_under_curve(rows):
    good = [s for s, y in rows if y]
    bad = [s for s, y in rows if not y]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    return wins / (len(good) * len(bad))


def test_factorisation_machine_sums_all_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=6), rng.normal(size=(6, 3))
    pairs = sum(float(v[i] @ v[j]) for i, j in itertools.combinations(range(6), 2))
    assert math.isclose(tx.logit(0.3, w, v), 0.3 + w.sum() + pairs)


def test_factors_learn_what_only_a_pair_tells():
    """Two terms are toxic together and harmless alone: no weights can say that."""
    a, b, rest = 1, 2, list(range(10, 40))
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(1200):
        has_a, has_b = rng.random(2) < 0.5
        columns = sorted({*rng.choice(rest, 3), *([a] if has_a else []), *([b] if has_b else [])})
        examples.append((int(has_a == has_b), np.array(columns, np.int32), None))
    p = tx.Machine(epochs=40, factor_rate=0.05, l1=0.1)
    model = tx.fit_machine(examples, p).astype(float)

    def of(columns):
        return tx.logit(model[-1, 0], model[columns, 0], model[columns, 1:])

    assert of([a, b]) > of([a]) and of([a, b]) > of([b]) and of([]) > of([a])


@pytest.mark.parametrize("toxic", ["both or neither", "both"])
def test_default_machine_learns_a_pair_among_many_terms(toxic):
    a, b = 1, 2
    rng = np.random.default_rng(1)
    examples = []
    for _ in range(10_000):
        has = rng.random(2) < 0.5
        columns = sorted({*(10 + rng.choice(2000, 100, replace=False)), *np.flatnonzero(has) + 1})
        label = has.all() or (toxic != "both" and not has.any())
        examples.append((int(label), np.array(columns, np.int32), None))
    model = tx.fit_machine(examples, tx.Machine()).astype(float)
    right = 0
    for label, columns, _ in examples[:2000]:
        score = tx.sigmoid(tx.logit(model[-1, 0], model[columns, 0], model[columns, 1:]))
        right += (score >= 0.3) == label
    assert right > 0.97 * 2000
    assert model[a, 1:] @ model[b, 1:] > 1


def test_quality_on_held_out_documents(spark, docs, labels):
    found = qc.quality(docs, labels).join(labels, "doc_id").filter("held_out")
    rows = [(r.score, r.quality) for r in found.collect()]
    assert area_under_curve(rows) > 0.95


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = tx.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert area_under_curve([(r.score, r.toxic) for r in found]) > 0.95
    clean = [r.predicted for r in found if r.toxic == 0]
    assert sum(clean) / len(clean) < 0.01


@pytest.mark.parametrize("operator", [qc.quality, tx.toxicity])
def test_scorers_on_odd_rows(spark, labels, operator):
    seen = operator(odd(spark), labels).collect()
    assert len(seen) == len(ODD)
    assert all(0 <= r.score <= 1 for r in seen)
    empty = {r.score for r in seen if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert operator(odd(spark).limit(0), labels).count() == 0
    none = operator(odd(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_labels_of_held_out_rows_are_not_used(spark, docs, labels):
    flipped = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    same = qc.fit_quality(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    other = qc.fit_quality(docs, flipped, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert np.array_equal(same, other)


def test_repeated_words_share_a_pair_term():
    columns, _ = qc.word_ngrams("aa aa aa", TermHashes())
    other, _ = qc.word_ngrams("bb bb", TermHashes())
    assert len(set(columns) & set(other)) == 1


def segmentations(word, pieces):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in pieces:
            for rest in segmentations(word[j:], pieces):
                yield [word[:j], *rest]


def test_forward_pass_sums_all_segmentations():
    pieces = object.__new__(li.Pieces)
    pieces.ids = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "bab"])}
    pieces.longest, pieces.unknown = 3, 6
    probs = np.vstack([np.random.default_rng(2).random((6, 2)), [[li.UNKNOWN] * 2, [0, 0]]])
    words = ["abab", "baba", "aaaa", "abba"]
    got = li.forward(pieces.lattice(words), probs)[-1]
    for word, row in zip(words, got, strict=True):
        want = sum(
            np.prod([probs[pieces.ids[p]] for p in cut], axis=0)
            for cut in segmentations(word, pieces.ids)
        )
        assert np.allclose(row, want)
    counts = li.expected_counts(pieces.lattice(["abab"]), probs[:, :1], np.array([2.0]))
    total, want = 0.0, np.zeros(8)
    for cut in segmentations("abab", pieces.ids):
        p = np.prod([probs[pieces.ids[x], 0] for x in cut])
        total += p
        for x in cut:
            want[pieces.ids[x]] += 2 * p
    assert np.allclose(counts, want / total)


def test_leader_updates_against_plain_code():
    """Follow the regularised leader, weight by weight, in plain numbers."""
    rng = np.random.default_rng(7)
    p = qc.Ftrl(epochs=2, alpha=0.4, beta=0.7, l1=0.3, l2=0.2)
    examples = []
    for _ in range(60):
        columns = np.unique(rng.integers(0, 12, 4))
        label = int(rng.random() < (0.8 if columns[0] < 4 else 0.2))
        examples.append((label, columns.astype(np.int32), rng.random(len(columns)).astype(np.float32)))
    z, n = Counter(), Counter()
    bias = 2**qc.BITS

    def weight(i):
        penalty = 0 if i == bias else p.l1
        if abs(z[i]) <= penalty:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * penalty) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for label, columns, values in examples:
            x = dict(zip(columns.tolist(), map(float, values), strict=True)) | {bias: 1.0}
            w = {i: weight(i) for i in x}
            chance = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (chance - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    got = qc.ftrl(examples, p)
    used = np.flatnonzero(got)
    assert 4 < len(used) and set(used.tolist()) <= set(z)
    for i in z:
        assert got[i] == pytest.approx(weight(i), abs=1e-9)


def test_repeated_label_rows_take_one_place_of_the_draw(spark):
    docs = spark.range(100).selectExpr("id doc_id", "'text ' || id text")
    labels = spark.range(100).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    again = spark.range(500).selectExpr("7L doc_id", "1 quality")
    sample = labelled_sample(docs, labels.union(again), "quality", F.lit(True), 50, 1).collect()
    assert len(sample) == 50 and len({r.text for r in sample}) == 50


def test_long_words_are_summed_without_a_border():
    """Sixty and more letters, against exact sums; also through the logarithms at every length."""
    pieces = object.__new__(li.Pieces)
    pieces.ids = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "bab"])}
    pieces.longest, pieces.unknown = 3, 6
    rng = np.random.default_rng(4)
    probs = np.vstack([rng.random((6, 2)) * 1e-6, [[li.UNKNOWN] * 2, [0, 0]]])
    for size in (4, 23, 24, 25, 60, 400):
        words = ["".join(rng.choice(list("abx"), size)) for _ in range(3)]
        found = li.word_logs(pieces.lattice(words), probs)
        logs = li.forward_logs(pieces.lattice(words), np.log(np.maximum(probs, 1e-320)))[-1]
        for word, row, other in zip(words, found, logs, strict=True):
            for language in range(2):
                sums = [Fraction(1)]
                for j in range(1, size + 1):
                    ways = [(i, pieces.ids.get(word[i:j])) for i in range(max(0, j - 3), j)]
                    ways = [(i, pieces.unknown if k is None and j - i == 1 else k) for i, k in ways]
                    sums.append(sum(sums[i] * Fraction(float(probs[k, language])) for i, k in ways if k is not None))
                exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
                assert row[language] == pytest.approx(exact) and other[language] == pytest.approx(exact)
        one = pieces.lattice(words[:1])
        plain = li._expected_by_logs(one, probs[:, :1], np.array([2.0]))
        if size < 30:
            assert np.allclose(plain, li.expected_counts(one, probs[:, :1], np.array([2.0])))
        used = sum(len(p) * plain[i] for p, i in pieces.ids.items()) + plain[pieces.unknown]
        assert used == pytest.approx(2 * size)


def test_sample_is_bounded_under_repeated_rows(spark):
    """A text that is most of the table counts once; the bound holds for every language."""
    rows = spark.range(20_000).selectExpr("'en' lang", "'the same text' text").union(
        spark.range(3000).selectExpr("if(id % 3 = 0, 'de', 'en')", "'text ' || id")
    )
    p = li.Learning(rows=50)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    for seed in range(6):
        p = li.Learning(rows=50, seed=seed)
        sample = li.language_sample(rows, counts, p).collect()
        found = Counter(r.lang for r in sample)
        assert max(found.values()) <= 50 and found["de"] > 35
        assert len(set(sample)) == len(sample)


def test_too_many_languages_fail(spark):
    docs = spark.range(40).selectExpr("id doc_id", "'l' || id lang", "'text here' text")
    with pytest.raises(ValueError, match="languages"):
        li.language_id(docs, li.Learning(model_bytes=10 * 8 * 32_000))


def test_language_of_held_out_documents(spark, docs):
    found = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_rows(spark):
    rows = {r.doc_id: r for r in li.language_id(odd(spark)).collect()}
    assert {rows[k].lang_pred for k in (1, 2, 5)} == {"und"}
    assert rows[4].lang_pred == "en" and rows[None].lang_pred == "en"
    assert li.language_id(odd(spark).limit(0)).count() == 0
    unknown = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.language_id(unknown).collect()} == {"und"}


def test_line_rules():
    text = "Home | About | Contact\nThis is a line of prose.\nmenu\nAll Rights Reserved.\na## b$$"
    found = qr.judged(text)
    assert found["clean_text"] == "This is a line of prose."
    assert found["n_removed_lines"] == 4 and found["n_kept_words"] == 6
    prose = " ".join(f"word{i}" for i in range(60))
    unended = " ".join(["word"] * 8)
    assert qr.judged("\n".join([unended] * 30))["n_removed_lines"] == 30
    assert qr.line_verdict(" ".join(["word"] * 21), qr.LineRules()) == (None, 21)
    assert qr.line_verdict(unended + ".", qr.LineRules()) == (None, 8)
    assert qr.judged(prose)["kept"] and not qr.judged(prose + "\n" + text * 9)["kept"]


def test_repeated_windows_against_plain_code():
    rng = np.random.default_rng(3)
    for _ in range(200):
        words = [str(x) for x in rng.integers(0, 4, rng.integers(0, 30))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        assert qr.repeated_window_words(words) == len(inside)


def test_rules_on_odd_rows(spark):
    rows = qr.quality_rules(odd(spark)).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    long = next(r for r in rows if r.doc_id == 4)
    assert long.n_words == 30_001 and long.base_failed
    assert qr.quality_rules(odd(spark).limit(0)).count() == 0
