"""Alignment of two public tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full content, so that copies meet before any work is done;
each distinct text is tokenised and aligned once and stands for as many documents as
have it. The byte offsets at which tokens of both kinds end cut a text into groups, and
the two tokens that end there are *linked*. How often an id pair is linked in the whole
corpus is counted with the multiplicity of the texts, and every text gets back how
many of its links are the best of their second id, and the sum of their counts.

Pairs that make up more than a ``1 / frequent`` of all links are fewer than ``frequent``
whatever the corpus; they are handed to the tasks. The links of all other pairs, none of
which is common enough to fill a task, are joined to the counts by pair. Measures come
back to documents by the SHA-256 of the text; texts with very many copies are served
from a broadcast that their share bounds.

Each step is written to the shared folder, so a lost executor repeats no tokenising but
its own.

Defined results: a text that is null or empty, or that the pieces of either tokenizer do
not spell byte for byte, has no tokens: all numbers are 0 and the digest is empty.
Repeated rows and null ids each get their row; columns besides ``doc_id`` and ``text``
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.llm.packing import byte_characters
from collidera.llm.skew import lookup
from collidera.sources.shared_folder import settled

SPACE = "▁"
LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Alignment:
    """Tokenizer files on every worker (None: those the environment offers); bounds.

    ``slice_chars`` of text are tokenised at once and about ``held_pairs`` partial counts
    are held by a task.
    """

    byte_level: str | None = None
    ranks: str | None = None
    pieces: str | None = None
    frequent: int = 1 << 20
    slice_chars: int = 1 << 20
    held_pairs: int = 1 << 22


class Encoders:
    """Both tokenizers, with the bytes and the printed id of every token.

    The first one is run from its rank file, which is the same vocabulary and several
    times faster, on all texts but very long ones: white space without end would overflow its stack.
    """

    LONG = 100_000

    def __init__(self, p: Alignment):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        def path(given: str | None, name: str) -> str:
            return given or public_tokenizers.path(name)

        self.a = Tokenizer.from_file(path(p.byte_level, "byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        with open(path(p.ranks, "byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=path(p.pieces, "piece_bpe_32k.model"))
        byte_of = {c: b for b, c in byte_characters().items()}
        named = self.a.get_vocab()
        self.bytes_a = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token))
        self.bytes_b = list(map(self._piece, range(self.b.get_piece_size())))
        self.sizes = [np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b)]
        #: Printed ids: inside a group, and at its end on either side.
        self.shown = [
            [np.array([f"{i}{mark}" for i in range(len(t))], object) for mark in (",", end)]
            for t, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))
        ]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def byte_level(self, text: str) -> list[int]:
        """Ids of the first kind."""
        if len(text) > self.LONG:
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def spells(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both kinds are the bytes of a space and the text."""
        whole = f" {text}".encode()
        return all(
            b"".join(map(kind.__getitem__, ids)) == whole
            for kind, ids in ((self.bytes_a, a), (self.bytes_b, b))
        )

    def of(self, texts: list[str]) -> list[tuple | None]:
        """``(n_a, n_b, n_groups, digest, pairs, counts)`` of each text, None where it is not spelled.

        ``pairs`` are the linked pairs as ``a << 32 | b``, each once, and ``counts`` how often
        each is linked. All texts are aligned at once, laid end to end.
        """
        first = [self.byte_level(f" {t}") for t in texts]
        found = list(zip(texts, first, self.b.encode(texts, num_threads=1), strict=True))
        spelled = [t != "" and self.spells(t, a, b) for t, a, b in found]
        rows: list[tuple | None] = [None] * len(texts)
        if not any(spelled):
            return rows
        kinds = [[row[k] for row, ok in zip(found, spelled, strict=True) if ok] for k in (1, 2)]
        ids = [np.fromiter(chain.from_iterable(k), np.int64) for k in kinds]
        tokens = [np.fromiter(map(len, k), np.int64, len(k)) for k in kinds]
        ends = [np.cumsum(size[i]) for size, i in zip(self.sizes, ids, strict=True)]
        last = []
        for own, other in (ends, reversed(ends)):
            there = np.zeros(own[-1] + 1, bool)
            there[other] = True
            last.append(np.flatnonzero(there[own]))
        border = ends[0][np.cumsum(tokens[0]) - 1]
        groups = np.searchsorted(ends[0][last[0]], border, "right")
        shown = self._printed(ids, last)
        pairs = ids[0][last[0]] << 32 | ids[1][last[1]]
        at = group = 0
        sizes = zip(np.flatnonzero(spelled).tolist(), *(t.tolist() for t in tokens), groups.tolist(), strict=True)
        for row, n_a, n_b, after in sizes:
            printed = "".join(shown[at : at + n_a + n_b])[:-1]
            digest = hashlib.sha256(printed.encode()).hexdigest()
            links = np.unique(pairs[group:after], return_counts=True)
            rows[row] = n_a, n_b, after - group, digest, *links
            at, group = at + n_a + n_b, after
        return rows

    def _printed(self, ids: list[np.ndarray], last: list[np.ndarray]) -> list[str]:
        """All tokens as they are printed, group by group, the first kind's before the second's."""
        sizes = [np.diff(np.append(-1, x)) for x in last]
        start = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
        out = np.empty(len(ids[0]) + len(ids[1]), object)
        for k, begin in ((0, start), (1, start + sizes[0])):
            own = np.arange(len(ids[k])) + np.repeat(begin - (np.cumsum(sizes[k]) - sizes[k]), sizes[k])
            inner, final = self.shown[k]
            out[own] = inner[ids[k]]
            out[own[last[k]]] = final[ids[k][last[k]]]
        return out.tolist()


_encoders: dict[Alignment, Encoders] = {}


def encoders(p: Alignment) -> Encoders:
    """The worker's encoders; later tasks find what earlier ones remembered."""
    if p not in _encoders:
        _encoders[p] = Encoders(p)
    return _encoders[p]


def slices(texts: list[str], size: int) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters."""
    part: list[str] = []
    room = size
    for text in texts:
        part.append(text)
        room -= len(text)
        if room <= 0:
            yield part
            part, room = [], size
    if part:
        yield part


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``(text, digest, copies)`` of the non-empty texts; copies meet by the whole text."""
    texts = documents.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select("text", digest().alias("digest"), "copies")


def digest(text: str = "text"):
    """Binary SHA-256 of a text."""
    return F.unhex(F.sha2(text, 256))


def alignments(texts: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """``(digest, copies, n_a, n_b, n_groups, groups_sha256, pairs, counts)`` of each text.

    ``pairs`` holds the distinct linked pairs as little-endian 64-bit ``a << 32 | b`` in
    order, ``counts`` how often each is linked in the text, as 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoders(p)
        for batch in batches:
            rows = []
            for part in slices(batch.column("text").to_pylist(), p.slice_chars):
                for whole in found.of(part):
                    if whole is None:
                        rows.append((0, 0, 0, "", b"", b""))
                        continue
                    *numbers, pairs, counts = whole
                    rows.append(
                        (*numbers, pairs.astype("<i8").tobytes(), counts.astype("<i4").tobytes())
                    )
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("copies")]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["digest", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"],
            )

    schema = (
        "digest binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string,"
        " pairs binary, counts binary"
    )
    return texts.select("digest", "copies", "text").mapInArrow(run, schema)


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a batch of alignments, their counts, and the row each stands in."""
    pairs, counts = batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()
    row = np.repeat(np.arange(len(pairs)), [len(x) // 8 for x in pairs])
    return np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(counts), "<i4"), row


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and the sums of their counts."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(aligned: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """``(pair, n, best)``: links of each pair in the corpus, and whether no other pair of
    its second id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def given() -> pa.RecordBatch:
            pairs, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            pairs, counts, row = flat(batch)
            copies = batch.column("copies").to_numpy()
            held.append(summed(pairs, counts * copies[row]))
            size += len(held[-1][0])
            if size > p.held_pairs:
                held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > p.held_pairs // 2:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    partial = aligned.select("copies", "pairs", "counts").mapInArrow(run, "pair long, n long")
    counted = settled(partial.groupBy("pair").agg(F.sum("n").alias("n"))).table
    # A second id has at most as many pairs as the first tokenizer has ids.
    second = F.col("pair").bitwiseAND(F.lit(LOW))
    most = counted.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    named = counted.withColumn("b", second).join(most, "b")
    return settled(named.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))).table


def link_measures(aligned: DataFrame, counted: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """``(digest, n_best, count_sum)`` of each aligned text, from the corpus-wide counts."""
    links = counted.agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") > links / p.frequent
    table = counted.where(is_frequent).toArrow().sort_by("pair")
    known = tuple(table.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = aligned.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, counts, row = flat(batch)
            size = batch.num_rows
            at = np.searchsorted(pair, pairs)
            there = at < len(pair)
            there[there] = pair[at[there]] == pairs[there]
            at, counts_known, row_known = at[there], counts[there].astype(np.int64), row[there]
            sums = np.zeros((2, size), np.int64)
            np.add.at(sums[0], row_known, counts_known * best[at])
            np.add.at(sums[1], row_known, counts_known * n[at])
            rest = ~there
            offsets = np.append(0, np.cumsum(np.bincount(row[rest], minlength=size)))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest"),
                    *map(pa.array, sums),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs[rest])),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[rest])),
                ],
                names=["digest", "n_best", "count_sum", "pairs", "counts"],
            )

    schema = "digest binary, n_best long, count_sum long, pairs array<long>, counts array<int>"
    found = settled(aligned.select("digest", "pairs", "counts").mapInArrow(run, schema)).table
    rest = found.select("digest", F.inline(F.arrays_zip("pairs", "counts")))
    rare = counted.where(~is_frequent).withColumnRenamed("pair", "pairs")
    added = (
        rest.join(rare, "pairs")
        .groupBy("digest")
        .agg(
            F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"),
            F.sum(F.col("counts") * F.col("n")).alias("count_sum"),
        )
    )
    both = found.select("digest", "n_best", "count_sum").unionByName(added)
    return both.groupBy("digest").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def token_alignment(documents: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``."""
    keyed = settled(
        documents.select("doc_id", F.when(F.length("text") > 0, digest()).alias("digest"))
    )
    aligned = settled(alignments(distinct_texts(documents), p)).table
    measures = link_measures(aligned, pair_counts(aligned, p), p)
    # Both ids of a common end are linked once, and each group ends at one.
    per_text = settled(
        aligned.join(measures, "digest").select(
            "digest",
            F.col("copies").alias("_n"),
            F.col("n_groups").alias("n_links"),
            *(n for n in NUMBERS if n != "n_links"),
            "groups_sha256",
        )
    ).table
    named = keyed.table.where("digest is not null")
    found = lookup(named, per_text, "digest", keyed.rows).select("doc_id", *NUMBERS, "groups_sha256")
    blank = keyed.table.where("digest is null").select(
        "doc_id", *(F.lit(0).cast("long").alias(n) for n in NUMBERS), F.lit("").alias("groups_sha256")
    )
    return found.unionByName(blank)
