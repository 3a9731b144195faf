"""Mixing, dialogues, archives, packing and the pipeline against plain code."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from collidera.llm import chat_formatting as cf
from collidera.llm import mixing as mx
from collidera.llm import packing as pk
from collidera.llm import warc as wa
from collidera.llm.session import importable
from collidera.sources.shared_folder import new_path, put_bytes

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None, "b", "en", 1, 9),
    (2, "", None, "en", None, 9),
    (2, "", None, "en", None, 9),
    (None, "a b c d", "a", None, 4, 9),
    (5, "word " * 50_000, "b", "de", 250_000, 9),
    (6, "Ⅷ ﬁ é <|endoftext|> ÀÉ don't x!'s 12 3\x85k  z", "c", "de", 40, 9),
]
DOCS = "doc_id long, text string, source string, lang string, n_chars long, size int"


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def plain_sainte_lague(weights, caps, seats):
    won = dict.fromkeys(weights, 0)
    for _ in range(min(seats, sum(caps.values()))):
        best = min(
            (k for k in weights if won[k] < caps[k]),
            key=lambda k: (-weights[k] / (2 * won[k] + 1), k),
        )
        won[best] += 1
    return won


def test_apportionment_against_plain_code(spark):
    rng = np.random.default_rng(7)
    for seats in (0, 1, 17, 400, 5000):
        weights = {f"p{i}": float(w) for i, w in enumerate(rng.choice([1, 1, 5, 90, 1000], 25))}
        total = sum(weights.values())
        caps = {k: int(np.ceil(seats * w / total)) + 1 for k, w in weights.items()}
        rows = [("g", k, w, seats, caps[k]) for k, w in weights.items()]
        table = spark.createDataFrame(rows, "g string, k string, w double, s long, c long")
        got = mx.apportioned(table, ["g"], "k", "w", "s", "c").collect()
        assert {r.k: r.quota for r in got} == plain_sainte_lague(weights, caps, seats)


def test_targets_fill_up_to_the_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 80}
    rows = [("s" + k if k else "n", k, v) for k, v in sizes.items()]
    table = spark.createDataFrame(rows, "key string, source string, source_size long")
    got = {r.source: r.target for r in mx.targets(table, mx.Mix()).collect()}
    weights, left, want = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(sizes.values()), {}
    free = dict(weights)
    while True:
        level = left / sum(free.values())
        full = [k for k in free if level * free[k] >= 2 * sizes[k]]
        if not full:
            break
        for k in full:
            want[k] = 2 * sizes[k]
            left -= want[k]
            del free[k]
    want |= {k: level * w for k, w in free.items()}
    assert got == pytest.approx(want)


def test_mix_meets_its_targets_and_agrees_with_its_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for mix in (mx.Mix(), mx.Mix(shard_rows=3)):
        rows = mx.mixed(docs, mix).join(docs.select("doc_id", "source"), "doc_id").collect()
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        taken, target = Counter(), {}
        for r in rows:
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - t) <= 16 + 0.01 * t for s, t in target.items())
    words = Counter()
    texts = mx.mixed_texts(docs)
    assert texts.schema == docs.schema
    for r in texts.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    plan = {r.doc_id: r.taken for r in mx.mixed(docs).collect()}
    assert {d: n for d, n in plan.items() if n} == dict(words)
    assert sorted(mx.mixed(docs).collect()) == sorted(mx.mixed(docs.repartition(5)).collect())


def test_rows_of_a_common_id_are_spread_and_reruns_agree(spark):
    """A third of the rows lacks an id, another third is one row over and over."""
    docs = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end doc_id",
        "if(id % 3 = 1, 'a b c', repeat('w ', int(id % 11))) text", "'s' source",
    )
    mix = mx.Mix(shard_rows=200)
    kinds = (docs, docs.repartition(7), docs.orderBy(F.rand(3)).coalesce(2))
    found = [Counter(map(tuple, mx.mixed(d, mix).collect())) for d in kinds]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == 6000
    plan = mx.mix_plan(docs, mix)
    largest = plan.groupBy("cell", "start", "blocks", "quota").count().agg(F.max("count")).first()[0]
    assert largest < 400
    taken = sum(n * row[4] for row, n in found[0].items())
    target = found[0].most_common(1)[0][0][3]
    assert abs(taken - target) < 0.01 * target


def test_mix_on_odd_rows(spark):
    rows = mx.mixed(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == by_id[2].size == by_id[2].taken == 0
    assert by_id[2].target == 0 and by_id[5].size == 50_000 and by_id[None].taken == 8
    assert mx.mixed(odd(spark).limit(0)).count() == 0


def test_mixed_texts_keep_rows_without_an_id_and_repeated_ids(spark):
    rows = [(None, f"n{i} " * (20 + i), "a", "en", None, i) for i in range(9)]
    rows += [(3, f"k{i} " * (40 + 7 * i), "b", "en", None, i) for i in range(5)] + [(3, None, "b", "en", None, 5)]
    rows += [(4, "same words again " * 10, "a", "en", None, 6)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    taken, found = Counter(), Counter()
    for r in mx.mixed(docs).collect():
        taken[r.doc_id] += r.taken
    texts = mx.mixed_texts(docs).collect()
    for r in texts:
        found[r.doc_id] += len(r.text.split())
    assert found == taken and found[None] > 0
    assert max(Counter((r.doc_id, r.size) for r in texts if r.doc_id != 4).values()) <= 2
    assert sum(r.doc_id == 4 for r in texts) <= 6


def test_all_stages_handle_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "GOOD", 0.0)
    monkeypatch.setattr(corpus_pipeline, "TOXIC", 1.1)
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {None, 5, 6} <= ids, name


def dialogue(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, prompt int")


def test_preference_pair(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "and?"), (1, 3, "assistant", "more")]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "good"), (2, 2, "user", "so?"), (2, 3, "assistant", None)]
    rows += [(3, 0, "user", "alone"), (3, 1, "assistant", "yes"), (4, 0, None, None), (5, 0, "user", "hi")]
    got = {r.chosen_id: r for r in cf.preferences(dialogue(spark, rows)).collect()}
    one = got[1]
    assert one.rejected_id == 2 and one.prompt_turns == 2
    assert one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\ngood<|end|>\n"
    assert one.chosen == "<|user|>\nand?<|end|>\n<|assistant|>\nmore<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_learned] == ["more<|end|>\n"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_learned] == ["<|end|>\n"]
    assert got[3].rejected_id is None and got[3].rejected is None
    assert got[3].prompt == "<|user|>\nalone<|end|>\n" and got[3].chosen == "<|assistant|>\nyes<|end|>\n"
    assert got[4].prompt == "<||>\n<|end|>\n" and got[5].rejected_id is None
    assert set(got) == {1, 3, 4, 5}
    assert cf.preferences(dialogue(spark, [])).count() == 0


def test_every_conversation_is_in_one_pair_however_common_its_opening(spark):
    rows = [(i, t, "user", "same" if t == 0 else str(i % 7)) for i in range(301) for t in range(2)]
    pairs = cf.paired_by_opening(cf.numbered(dialogue(spark, rows)), group_rows=20).collect()
    ids = [x for r in pairs for x in (r.chosen_id, r.rejected_id) if x is not None]
    assert sorted(ids) == list(range(301))
    assert sum(r.rejected_id is None for r in pairs) == 1
    whole = cf.preferences(dialogue(spark, rows + rows[:2])).collect()
    assert len(whole) == 151


def test_rows_without_a_conversation_stay_apart(spark):
    """Each is a conversation of its own, paired by its opening like any other."""
    rows = [(None, t % 3, "user", "same" if t % 2 else f"other {t}") for t in range(300)]
    rows += [(1, 0, "user", "same"), (1, 1, "assistant", "x"), (2, 0, "user", "alone")]
    known = cf.numbered(dialogue(spark, rows))
    assert cf.conversations_of(known).selectExpr("max(size(turns))").first()[0] == 2
    found = cf.preferences(dialogue(spark, rows)).collect()
    # 151 conversations begin alike per number of the turn; nothing is lost or doubled.
    shown = sum(r.prompt_turns for r in found)
    assert len(found) < 302 and sum(r.prompt.count("same") for r in found) >= 75
    both = sum(1 + (r.rejected is not None) for r in found)
    assert both == 302 and shown >= len(found) - 1


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


PAGES = [(i, f"http://x/{i}", f"<p>{i}</p>" + "é" * 300) for i in range(40)]
PAGES += [(100, "http://x/a", PAGES[3][2]), (101, None, PAGES[3][2]), (1, "u", "short"), (102, "a\r\nb", "short")]
PAGES += [(103, "", None), (104, "", ""), (None, "http://n", PAGES[4][2]), (105, "z", "w" * 300_000)]


def plain_roles(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html] = min(first.get(html, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and i != first.get(html, i)
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None


def test_archives_round_trip(spark):
    small = wa.Archives(archive_bytes=2000)
    got = [tuple(r) for r in wa.warc_round_trip(pages(spark, PAGES), small).collect()]
    assert Counter(got) == Counter(plain_roles(PAGES))
    assert wa.warc_round_trip(pages(spark, [])).count() == 0
    folder = new_path(spark, "warc")
    wa.write_warc(pages(spark, PAGES), folder)
    read = wa.read_warc(spark, folder).filter("record_type = 'response'").collect()
    texts = {r.record_id: r.payload.decode() for r in read}
    assert all(texts[f"<urn:page:{i}>"] == h for i, _, h in PAGES[:40] if i != 1)


def archive(compressed):
    found = []
    for i in range(12):
        body = f"<p>page {i}</p>".encode() * 20
        data = wa.record_bytes(i, f"http://x/{i}", body, len(body), hashlib.sha256(body).hexdigest(), "response", None, "2024-01-01T00:00:00Z")
        found.append(wa.gzip_member(data, 6) if compressed else data)
    return found


@pytest.mark.parametrize("compressed", [True, False])
def test_damage_is_skipped_and_logged(compressed):
    parts = archive(compressed)
    rng = np.random.default_rng(8)
    sound = list(wa.salvaged(b"".join(parts)))
    assert len(sound) == 12 and all(x[2] is None for x in sound)
    for _ in range(60):
        broken = set(rng.choice(12, 3, replace=False).tolist())
        data = []
        for i, part in enumerate(parts):
            if i in broken:
                kind = rng.integers(3)
                cut = int(rng.integers(5, len(part) - 30))
                part = {
                    0: part[:cut],
                    1: part[:cut] + bytes(rng.integers(0, 256, 20, dtype=np.uint8)) + part[cut + 20 :],
                    2: bytes(rng.integers(0, 256, 40, dtype=np.uint8)) + part[11:],
                }[int(kind)]
            data.append(part)
        whole = b"".join(data)
        found = list(wa.salvaged(whole))
        ids = {x[3]["warc-record-id"] for x in found if x[2] is None}
        assert {f"<urn:page:{i}>" for i in set(range(12)) - broken} <= ids
        at = 0
        for offset, length, *_ in found:
            assert offset == at
            at += length
        assert at == len(whole)
        assert not compressed or any(x[2] for x in found)


def ids_in(data):
    return [x[3]["warc-record-id"] for x in wa.salvaged(data) if x[2] is None]


def test_records_of_damaged_members_are_kept():
    """Ten records in one member: cut at its end, with a bad first line, with wrong bytes inside."""
    parts = archive(False)[:10]
    names = [f"<urn:page:{i}>" for i in range(10)]
    rng = np.random.default_rng(2)
    noise = bytes(rng.integers(0, 256, 4000, dtype=np.uint8))
    other = archive(True)[11]
    member = wa.gzip_member(b"".join(parts), 0)
    assert ids_in(member + other) == [*names, "<urn:page:11>"]
    assert ids_in(member[:-8] + other) == [*names, "<urn:page:11>"]
    assert ids_in(member[:-20] + other) == [*names[:9], "<urn:page:11>"]
    assert ids_in(member[: len(member) // 2] + noise + other) == [*names[:4], "<urn:page:11>"]
    bad_line = wa.gzip_member(b"XARC/1.1" + b"".join(parts)[8:], 6)
    assert ids_in(bad_line + other) == [*names[1:], "<urn:page:11>"]
    wrong_sum = bytearray(wa.gzip_member(b"".join(parts), 6))
    wrong_sum[-6] ^= 1
    found = list(wa.salvaged(bytes(wrong_sum) + other))
    assert [x[3]["warc-record-id"] for x in found if x[2] is None] == [*names, "<urn:page:11>"]
    assert [x[:3] for x in found if x[2]] == [(0, len(wrong_sum), "gzip member is damaged")]


def test_reading_takes_linear_time():
    """Twice the members take about twice the time, however small they are."""
    def seconds(n):
        data = b"".join(archive(True)) * n
        start = time.process_time()
        assert sum(x[2] is None for x in wa.salvaged(data)) == 12 * n
        return time.process_time() - start

    seconds(50)
    assert seconds(8000) < 12 * max(seconds(2000), 0.1)


def test_reader_reports_gaps(spark):
    parts = archive(True)
    path = new_path(spark, "damaged")
    put_bytes(spark, f"{path}/a.warc.gz", parts[0] + parts[1][:-20] + b"junk" + parts[2])
    rows = wa.read_warc(spark, path).orderBy("offset").collect()
    assert [r.damage is None for r in rows] == [True, False, True]
    assert rows[1].offset == len(parts[0]) and rows[1].length == len(parts[1]) - 16


def test_fragments_encode_like_whole_texts(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text or "" for r in odd(spark).collect()]
    texts += [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    texts += ["".join(map(chr, range(1, 0x250))), "Å ́x ß ẞ İı ªº½ 中文字 🙂! 's'S'LL", "we've I'M ''' -- a'd"]
    encode = pk.Encoder().encode
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def plain_bm25(documents, query, k1, b):
    n, mean = len(documents), np.mean([max(1, len(d)) for d in documents])
    scores = np.zeros(n)
    for t in set(query.tolist()):
        df = sum(t in d for d in documents)
        idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        for i, d in enumerate(documents):
            tf = int((d == t).sum())
            scores[i] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(1, len(d)) / mean))
    return scores


def test_index_scores_like_the_formula():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint32) for _ in range(20)]
    index = pk.Bm25(docs, 1.2, 0.75)
    for d in docs:
        assert np.allclose(index.scores(d), plain_bm25(docs, d, 1.2, 0.75))


def test_neighbours_share_windows():
    rng = np.random.default_rng(10)
    tails = [rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 50).astype(np.uint32) for i in range(40)]
    pieces = pk.packed([50] * 40, tails, pk.Packing(window=250))
    topics = defaultdict(Counter)
    for d, _, n, sequence, _ in pieces:
        topics[sequence][d % 4] += n
    pure = [max(c.values()) / sum(c.values()) for c in topics.values()]
    assert np.mean(pure) > 0.9


@pytest.mark.parametrize("rows", ["odd", "documents"])
def test_every_token_is_packed_once(spark, rows):
    docs = odd(spark) if rows == "odd" else spark.read.parquet(f"{SF_DIR}/documents.parquet")
    p = replace(pk.Packing(), shard_bytes=100_000)
    found = pk.pack(docs, p).collect()
    encode = pk.Encoder().encode
    want = Counter((r.doc_id, encode(r.text or "") + b"\x02\x00\x00\x00") for r in docs.collect())
    by_sequence, starts = defaultdict(list), defaultdict(list)
    for r in found:
        data = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id, r.doc_tokens].append((r.start, data))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for (doc_id, n), pieces in starts.items():
        whole = Counter({d: c for (i, d), c in want.items() if i == doc_id and len(d) == 4 * n})
        copies = sum(whole.values())
        assert sum(len(d) for _, d in pieces) == 4 * n * copies
        if copies == 1:
            assert b"".join(d for _, d in sorted(pieces)) == next(iter(whole))
    assert sum(r.length for r in found) == sum(len(d) // 4 * c for (_, d), c in want.items())
    assert pk.pack(docs.limit(0), p).count() == 0


def test_large_ids_stay_exact_beside_nulls(spark):
    """64-bit ids do not pass through floats, whatever else a shard holds."""
    ids = [None, 2**60 + 1, None, -(2**62) - 1, 2**53 + 1]
    docs = spark.createDataFrame([(i, f"some words {i}") for i in ids], "doc_id long, text string")
    found = pk.pack(docs.coalesce(1)).collect()
    assert Counter(r.doc_id for r in found) == Counter(ids)
    named = spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string")
    assert {r.doc_id for r in pk.pack(named).collect()} == {"a", None}


def test_close_documents_meet_in_a_shard(spark):
    """Documents of 40 topics, dealt at random, in shards of about one topic each."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]
    topic = rng.permutation(np.repeat(np.arange(40), 25))
    texts = [" ".join(words[t * 100 + k] for k in rng.integers(0, 100, 60)) for t in topic]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    p = replace(pk.Packing(), window=512, shard_bytes=12_000, bytes_per_token=2)
    rows = pk.pack(docs.repartition(7), p, with_ids=False).collect()
    shares = defaultdict(Counter)
    for r in rows:
        shares[r.sequence_id][int(topic[r.doc_id])] += r.length
    pure = [max(c.values()) / sum(c.values()) for c in shares.values()]
    assert len(shares) > 100 and np.mean(pure) > 0.5


def test_copies_share_a_key_and_fill_many_shards(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('same words here ', 100) AS text")
    p = replace(pk.Packing(), shard_bytes=50_000)
    keyed = pk.encoded(docs, p)
    assert keyed.select("key").distinct().count() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.createDataFrame(pk.pack(docs, p, with_ids=False).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Ranges are cut inside the key, and shards are cut inside ranges.
    assert rows.selectExpr("sequence_id >> 32 AS task").distinct().count() > 4
    assert rows.select("doc_id").distinct().count() == 3000


def test_pipeline_stages_do_what_their_operators_say(spark):
    from collidera.llm.quality_classifier import fit_quality, quality_scorer
    from collidera.llm.simhash import simhash_dedup
    from collidera.llm.terms import with_score
    from collidera.llm.toxicity import fit_toxicity, toxicity_scorer

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = new_path(spark, name)
        out.write.parquet(path)
        kept[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = kept["quality"]
    scores = with_score(before, quality_scorer(spark, fit_quality(before, labels, F.lit(True))))
    assert ids(after) == ids(scores.filter("_score >= 0.5"))
    before, after = kept["toxicity"]
    scores = with_score(before, toxicity_scorer(spark, fit_toxicity(before, labels, F.lit(True))))
    assert ids(after) == ids(scores.filter("_score < 0.3"))
    before, after = kept["near_duplicates"]
    assert ids(after) == ids(simhash_dedup(before).filter("doc_id = component_id"))
    before, after = kept["mix"]
    words = sum(len(r.text.split()) for r in before.collect())
    mixed = sum(len(r.text.split()) for r in after.collect())
    assert abs(mixed - 1.5 * words) < 0.01 * words
    packed = corpus_pipeline.packed_documents(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Different texts of one id and texts without an id all have their say."""
    long = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, long[0]), (1, long[1]), (1, long[0]), (None, long[1]), (None, long[2]), (None, long[2]), (0, long[3]), (5, long[3])]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _row int")
    kept = corpus_pipeline.distinct_documents(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, long[0]), (1, long[1]), (None, long[2]), (0, long[3])], key=str)


def test_pipeline_filters_handle_odd_rows(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == odd(spark).columns
        docs.collect()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd(spark).limit(0), SF_DIR).collect()
