"""Alignment of two tokenizers against plain code."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from collidera.llm import queries
from collidera.llm import token_alignment as ta
from collidera.llm.session import importable


@pytest.fixture(scope="module", autouse=True)
def reachable(spark):
    importable(spark)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def printable_bytes():
    """Bytes of the characters that byte-level tokens are written with."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)
    }


def plain_tokens(tokenizers, text):
    """``(id, end)`` of the tokens of both kinds, None where either does not spell the text."""
    a, b = tokenizers
    byte_of = printable_bytes()
    whole = f" {text}".encode()
    first = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        is_byte = len(piece) == 6 and piece.startswith("<0x") and b.is_byte(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()))
    both = []
    for tokens in (first, second):
        if b"".join(t for _, t in tokens) != whole:
            return None
        end, found = 0, []
        for i, token in tokens:
            end += len(token)
            found.append((i, end))
        both.append(found)
    return both


def plain(tokenizers, texts):
    """Everything the operator returns, token by token."""
    rows, links, totals = [], [], Counter()
    for text in texts:
        both = plain_tokens(tokenizers, text) if text else None
        if both is None:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        a, b = both
        ending = {}
        for i, x in a:
            ending.setdefault(x, []).append(i)
        found = [(i, j) for j, y in b for i in ending.get(y, [])]
        ends = sorted({x for _, x in a} & {y for _, y in b})
        shown = []
        rest = [list(a), list(b)]
        for end in ends:
            parts = []
            for side in rest:
                size = sum(1 for _ in itertools.takewhile(lambda token: token[1] <= end, side))
                parts.append(",".join(str(i) for i, _ in side[:size]))
                del side[:size]
            shown.append("|".join(parts))
        rows.append((len(a), len(b), len(ends), hashlib.sha256(";".join(shown).encode()).hexdigest()))
        links.append(found)
        totals.update(found)
    most = Counter()
    for (_, j), n in totals.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, groups, len(own), sum(totals[p] == most[p[1]] for p in own), sum(totals[p] for p in own), sha)
        for (n_a, n_b, groups, sha), own in zip(rows, links, strict=True)
    ]


TEXTS = [
    None, "", " ", "a", "hello world", "  two  spaces\n\n x", "tab\tx\r\n", "\x00b", "<unk> <s>",
    "naïve é漢字 😀 مرحبا", "▁x", "<|endoftext|>", "<0x41>", "é ﬁ", "the cat " * 40, "hello world", "HELLO",
]


def rows_of(df):
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("frequent", [1 << 20, 1, 20])
def test_odd_texts(spark, tokenizers, frequent):
    """Rare and frequent pairs take different ways to the same numbers."""
    texts = TEXTS + ["the cat hello", "hello world"] * 3
    docs = spark.createDataFrame(
        [(None if i == 4 else i // 2, t, i, "x") for i, t in enumerate(texts)],
        "doc_id int, text string, n_a int, digest string",
    )
    want = [((None if i == 4 else i // 2), *r) for i, r in enumerate(plain(tokenizers, texts))]
    got = ta.token_alignment(docs, ta.Alignment(frequent=frequent, slice_chars=20, held_pairs=10))
    assert rows_of(got) == sorted(want, key=str)


def test_rank_file_gives_the_same_ids():
    """White space of every kind, in every company, and runs of it up to the limit."""
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "\x00"]
    parts += ["ab", "don't", "1", "23", "!?", "é", "ﬁ", "e\u0301", "漢字", "😀", "'s", "<s>", "'", "x.y", "▁"]
    parts += ["<|endoftext|>", "Ⅷ", "²", "अ", "\u094d", "'S"]
    found = ta.Encoders(ta.Alignment())
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(8000)]
    texts += [c * found.LONG for c in (" ", "\n", "z", "漢", "!")]
    assert [found.fast.encode_ordinary(t) for t in texts] == [
        e.ids for e in found.a.encode_batch(texts, add_special_tokens=False)
    ]
    assert len(found.byte_level(" " * 1_000_000)) == 1_000_000


def test_registered_query(spark, tokenizers):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain(tokenizers, [r.text for r in docs])
    got = rows_of(queries.queries()["op13_token_alignment"](spark, sf_dir))
    assert got == sorted(((r.doc_id, *w) for r, w in zip(docs, want, strict=True)), key=str)


def test_hot_and_very_long_texts(spark, tokenizers):
    """Thousands of copies are one text; a text of millions of characters is one too."""
    long = "lorem ipsum dolor " * 150_000 + " " * 200_000 + "z" * 100_000
    texts = ["same words again"] * 3000 + [long, "z" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    assert ta.distinct_texts(docs).count() == 3
    got = {r["doc_id"]: r for r in ta.token_alignment(docs).collect()}
    assert len(got) == 3002
    assert len({tuple(r)[1:] for i, r in got.items() if i < 3000}) == 1
    [(n_a, n_b, groups, *_, sha)] = plain(tokenizers, ["same words again"])
    assert (got[7]["n_a"], got[7]["n_b"], got[7]["n_groups"], got[7]["groups_sha256"]) == (n_a, n_b, groups, sha)
    assert got[3000]["n_groups"] > 400_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    got = ta.token_alignment(docs)
    assert got.collect() == [] and got.schema["doc_id"].dataType.simpleString() == "string"


def test_summed():
    pairs, counts = ta.summed(np.array([3, 1, 3, 2]), np.array([1, 2, 3, 4]))
    assert pairs.tolist() == [1, 2, 3] and counts.tolist() == [2, 4, 4]
    assert ta.summed(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].tolist() == []
