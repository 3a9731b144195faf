"""Packing documents into windows with their lexical neighbours.

Documents are encoded once and written as token ids with a content key: four weighted
min-hashes of the distinct ids, later ids of the vocabulary weighing more as they are
rarer. Documents with much in common share the first of them with a likelihood that grows with what
they share, and so stand side by side when the table is put in order of the keys. The
ordered ranges are cut into shards of about ``shard_bytes`` of text, so close documents
meet in a shard at every size of the table, and a key that very many documents share is
cut like any other.

In a shard, whole windows are cut off long documents first; what is left of each document
goes into a BM25 inverted index over token ids. Then windows are filled greedily: a seed
document, its best unused neighbours by score, and, when none shares a weighted term with
it, the next unused documents. The document that does not fit is cut, and its rest seeds
the next window. Only the last window of a shard is padded.

Tokens come from a public tokenizer file that is only read. Pieces of text between
ASCII white space are encoded independently and remembered, which gives the same ids as
encoding the text at once because the tokenizer never joins across white space.

Defined results: a null or empty text is one end token. Repeated rows are separate
documents; null ids stay. Columns besides ``doc_id`` and ``text`` are ignored; an empty
table gives an empty one. A lost task packs its range again in the same way.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.sources.shared_folder import settled

FRAGMENT = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts of these characters need no Unicode normalisation; each lower-cases to itself
#: or to one other of them.
PLAIN = re.compile(r"[\x09-\x0D\x20-~À-ÖØ-öø-ÿ]+")
LETTERS = "a-zß-öø-ÿ"
#: Of the min-hashes.
SALTS = np.array([1, 2, 3, 4], np.uint64) << np.uint64(20)
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}\x09-\x0D\x20]+"
)


@dataclass(frozen=True)
class Packing:
    """``tokenizer`` is a file on every worker; None is the one the environment offers.

    Its ids have to fit ``id_bytes``, 2 or 4. A shard holds ``shard_bytes`` of text at
    ``bytes_per_token``.
    """

    window: int = 4096
    end_id: int = 2
    shard_bytes: int = 4 << 20
    bytes_per_token: int = 3
    id_bytes: int = 2
    k1: float = 1.2
    b: float = 0.75
    tokenizer: str | None = None


def byte_characters() -> dict[int, str]:
    """Printable stand-ins of bytes, as byte-level tokenizers write them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered(dict):
    """Results by text, computed when they are first asked for.

    Two generations are kept: when the newer one is full the older one is forgotten, and
    what is asked for again moves from the older to the newer one.
    """

    KEPT = 250_000

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.compute(text)
        if len(self) >= self.KEPT:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


class Encoder:
    """Ids of whole texts, as little-endian numbers of ``id_bytes`` bytes.

    A text of plain characters is parted into words, each encoded once; any other text into
    the pieces between white space.
    """

    def __init__(self, path: str | None = None, id_bytes: int = 4):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        if self.size > 256**id_bytes:
            raise ValueError(f"ids of {path} need more than {id_bytes} bytes")
        self.kind = f"<u{id_bytes}"
        self.code = {2: "H", 4: "I"}[id_bytes]
        self.characters = byte_characters()
        self.words = Remembered(self._word)
        self.fragments = Remembered(self._fragment)

    def _word(self, word: str) -> bytes:
        shown = word
        if not word.isascii():
            shown = "".join(map(self.characters.__getitem__, word.encode()))
        tokens = self.tokenizer.model.tokenize(shown)
        return array(self.code, [token.id for token in tokens]).tobytes()

    def _fragment(self, fragment: str) -> bytes:
        if "<|" not in fragment and PLAIN.fullmatch(fragment):
            return self._plain(fragment)
        ids = self.tokenizer.encode(fragment, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join(map(self.fragments.__getitem__, FRAGMENT.findall(text)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None, id_bytes: int) -> Encoder:
    """The worker's encoder of a file; later tasks find what earlier ones remembered."""
    if (path, id_bytes) not in _encoders:
        _encoders[path, id_bytes] = Encoder(path, id_bytes)
    return _encoders[path, id_bytes]


class Bm25:
    """Inverted index over the term ids of a shard's documents.

    Terms that half of the documents or more have carry no weight and have no list.
    """

    def __init__(self, documents: list[np.ndarray], k1: float, b: float):
        n = len(documents)
        counted = [np.unique(d, return_counts=True) for d in documents]
        sizes = np.array([len(t) for t, _ in counted], np.int64)
        term = np.concatenate([t for t, _ in counted])
        tf = np.concatenate([c for _, c in counted]).astype(np.float64)
        doc = np.repeat(np.arange(n), sizes)
        length = np.array([max(1, len(d)) for d in documents], np.float64)
        self.terms, place, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(np.maximum(1.0, (n - df + 0.5) / (df + 0.5)))
        norm = k1 * (1 - b + b * length / length.mean())
        weight = idf[place] * tf * (k1 + 1) / (tf + norm[doc])
        used = weight > 0
        order = np.argsort(place[used], kind="stable")
        self.doc, self.weight = doc[used][order], weight[used][order]
        lists = np.bincount(place[used], minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(lists)])
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every document for the distinct terms of a query."""
        at = np.searchsorted(self.terms, np.unique(query))
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        offsets = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        postings = np.repeat(first, size) + offsets
        return np.bincount(self.doc[postings], self.weight[postings], minlength=self.n)


def packed(lengths: list[int], tails: list[np.ndarray], p: Packing) -> list[tuple]:
    """``(document, start, length, sequence, offset)`` of every piece of a shard."""
    pieces, sequence = [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - p.window + 1, p.window):
            pieces.append((d, start, p.window, sequence, 0))
            sequence += 1
    left = np.array([len(t) for t in tails])
    unused = left > 0
    if not unused.any():
        return pieces
    index = Bm25(tails, p.k1, p.b)
    queue = iter(np.flatnonzero(unused).tolist())
    seed, filled = None, 0
    while True:
        if seed is None:
            seed = next((d for d in queue if unused[d]), None)
            if seed is None:
                break
        scores = np.where(unused, index.scores(tails[seed]), 0.0)
        scores[seed] = 0
        found = np.flatnonzero(scores)
        near = iter(found[np.argsort(-scores[found], kind="stable")].tolist())
        others = (d for d in queue if unused[d])
        current, seed = seed, None
        while current is not None:
            size = min(int(left[current]), p.window - filled)
            start = lengths[current] - int(left[current])
            pieces.append((current, start, size, sequence, filled))
            left[current] -= size
            filled += size
            unused[current] = left[current] > 0
            if filled == p.window:
                seed = current if unused[current] else None
                sequence, filled = sequence + 1, 0
                break
            current = next(near, None)
            if current is None:
                current = next(others, None)
        if current is None:
            break
    return pieces


def waiting_times(size: int) -> np.ndarray:
    """For each min-hash an exponential waiting time of every id of a vocabulary.

    It comes from the id's hash and is shorter the later the id stands in the vocabulary;
    the id of a document that arrives first is its min-hash.
    """
    ids = np.arange(size, dtype=np.uint64)
    mixed = (ids[None] + SALTS[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    uniform = ((mixed >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return -np.log(uniform) / (ids.astype(np.float64) + 1)


def content_key(ids: np.ndarray, waiting: np.ndarray) -> int:
    """The min-hashes of a document's ids, 15 bits each, the first one highest."""
    key = 0
    for times in waiting:
        first = int(ids[np.argmin(times[ids])])
        key = key << 15 | (first * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 49
    return key


def encoded(documents: DataFrame, p: Packing = Packing()) -> DataFrame:
    """``(doc_id, ids, key)``: token ids of ``id_bytes`` with the end token, and the content key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(p.tokenizer, p.id_bytes)
        end, waiting = np.array([p.end_id], found.kind).tobytes(), waiting_times(found.size)
        for batch in batches:
            ids = [found.encode(t or "") + end for t in batch.column("text").to_pylist()]
            keys = [content_key(np.frombuffer(x, found.kind), waiting) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(keys, pa.int64())],
                names=["doc_id", "ids", "key"],
            )

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, ids binary, key long"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def packed_shard(rows: pa.Table, p: Packing, first: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    """Pieces of a shard, its sequences numbered from ``first``, and the number after them."""
    every = rows.column("ids").to_pylist()
    lengths = [len(x) // p.id_bytes for x in every]
    whole = np.frombuffer(b"".join(every), f"<u{p.id_bytes}").astype("<u4")
    ids = np.split(whole, np.cumsum(lengths)[:-1])
    tails = [x[n - n % p.window :] for x, n in zip(ids, lengths, strict=True)]
    pieces = packed(lengths, tails, p)
    doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
    spans = [ids[d][a : a + n] for d, a, n, _, _ in pieces]
    columns = {
        "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(doc)),
        "start": pa.array(start),
        "length": pa.array(length),
        "ids_crc32": pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64()),
        "doc_tokens": pa.array(np.array(lengths, np.int64)[doc]),
        "sequence_id": pa.array(first + sequence),
        "offset": pa.array(offset),
    }
    if with_ids:
        columns["ids"] = pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns), first + int(sequence[-1]) + 1


def pack(documents: DataFrame, p: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, if asked for, ``ids``, the piece's token ids.

    Pieces of a sequence stand next to each other from offset 0; what is missing to the
    window is padding.
    """
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {doc_id}, start long, length long, ids_crc32 long, doc_tokens long,"
        " sequence_id long, offset long" + ", ids array<int>" * with_ids
    )
    shard_ids = p.id_bytes * max(1, p.shard_bytes // p.bytes_per_token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held, room = [], shard_ids

        def given() -> pa.RecordBatch:
            nonlocal sequence
            found, sequence = packed_shard(pa.Table.from_batches(held), p, sequence, with_ids)
            return found

        for batch in batches:
            sizes = pc.binary_length(batch.column("ids")).to_numpy()
            begin = 0
            while begin < len(sizes):
                # Rows up to the one that fills the shard.
                after = np.cumsum(sizes[begin:], dtype=np.int64)
                end = begin + int(np.searchsorted(after, room)) + 1
                held.append(batch.slice(begin, end - begin))
                room -= int(sizes[begin:end].sum())
                begin = end
                if room <= 0:
                    yield given()
                    held, room = [], shard_ids
        if held:
            yield given()

    keyed = settled(encoded(documents, p)).table
    # Copies of a key are cut wherever a range is full.
    salted = keyed.withColumn("salt", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    ordered = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    return ordered.select("doc_id", "ids").mapInArrow(run, schema)
