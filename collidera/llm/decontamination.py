"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of about ``shard_bytes`` and sorts the word
suffixes of a shard. Each suffix of each benchmark item is looked up there by binary
search: the range of the array that shares its first ``window`` words holds all places
of that window, and narrowing the range word by word until it is empty gives the longest
verbatim match. A document word inside any found window is *hit*.

Words are runs of ASCII letters (in lower case), digits and non-ASCII characters. An
item with fewer than ``window`` words is one window as a whole. Suffixes that begin
with a word no item has cannot match and are left out of the array; such a word also
ends every match, and so does the end of a document.

Documents are never shuffled. Items are broadcast in blocks of ``block_bytes`` of text;
each block is a pass over the documents that adds to what earlier blocks found. A longer
item is a block of its own. At least one block is searched, so nothing depends on the
size of the benchmark but the number of passes.

Defined results: a null text has no words, an item without words has no windows. Rows
are documents: repeated rows and null ids each get a row. An item is an ``item_id``:
rows that repeat one are one item, and an item without an id marks words but is neither
counted nor listed. Columns besides the text and the ids are ignored here and kept by
``decontaminated``; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collidera.functions.cells import cell
from collidera.sources.shared_folder import settled

#: Letters in lower case, digits and bytes of non-ASCII characters stay, all else parts words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


@dataclass(frozen=True)
class Search:
    """Parameters: words of a window, bytes of text of a shard and of a block of items."""

    window: int = 10
    shard_bytes: int = 8 << 20
    block_bytes: int = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Benchmark:
    """Words of some items as numbers, their suffixes and their distinct windows.

    ``stream`` holds the items one after the other, each followed by a 0. A suffix is a
    place in it with ``left`` words to the end of its item.
    """

    def __init__(self, items: list[tuple[Any, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[Any] = []
        parts, lengths = [], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                parts.append(np.array([*number, 0], np.int64))
                lengths.append(len(words))
                self.ids.append(item_id)
        size = np.array(lengths, np.int64)
        self.stream = np.concatenate([np.zeros(0, np.int64), *parts])
        item = np.repeat(np.arange(len(size)), size + 1)
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        place = np.arange(len(self.stream))
        left = (start + size)[item] - place
        keep = left > 0
        self.suffix, self.item, self.left = place[keep], item[keep], left[keep]
        self.item_start = self.suffix - start[self.item]
        self.longest = int(size.max(initial=0))
        self.base = len(self.vocabulary) + 1
        #: Words that one 64-bit key can hold.
        self.packed = max(1, 62 // self.base.bit_length())
        self.keys = packed_keys(self.stream, run_lengths(self.stream), self.base, self.packed)
        #: Words that a match must have.
        self.needed = np.minimum(size, window)[self.item]
        self._windows(self.needed, window)

    def _windows(self, width: np.ndarray, window: int) -> None:
        """``width`` of each suffix's window, 0 where it has none or an earlier one has it."""
        whole = np.flatnonzero(self.left >= width)
        at = self.suffix[whole, None] + np.arange(window)
        inside = np.arange(window) < width[whole, None]
        rows = np.where(inside, self.stream[np.minimum(at, len(self.stream) - 1)], 0)
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.width = np.zeros(len(self.suffix), np.int64)
        self.width[whole[first]] = width[whole[first]]
        # Items of each distinct window, side by side; a window is known by its first suffix.
        pairs = np.unique(np.stack([whole[first][which.ravel()], self.item[whole]], 1), axis=0)
        self.owner, self.owned = pairs[:, 0], pairs[:, 1]

    def items_of(self, suffix: int) -> list[Any]:
        """Ids of the items that have the window of a suffix."""
        a, b = np.searchsorted(self.owner, [suffix, suffix + 1])
        return [self.ids[i] for i in self.owned[a:b]]


def run_lengths(words: np.ndarray) -> np.ndarray:
    """How many words follow from each place, itself included, before a 0 or the end."""
    place = np.arange(len(words))
    ends = np.append(np.flatnonzero(words == 0), len(words))
    return ends[np.searchsorted(ends, place)] - place


def packed_keys(words: np.ndarray, runs: np.ndarray, base: int, count: int) -> np.ndarray:
    """The first ``count`` words from each place as one number, 0 from the end of the run."""
    keys = np.zeros(len(words), np.int64)
    padded = np.append(words, np.zeros(count, words.dtype))
    for j in range(count):
        keys = keys * base + np.where(j < runs, padded[j : j + len(words)], 0)
    return keys


class SuffixArray:
    """Suffixes of a shard's words in order, as far as ``depth`` words tell them apart."""

    def __init__(self, words: np.ndarray, base: int, packed: int, depth: int):
        self.words = np.append(words, 0)
        runs = run_lengths(words)
        keys = packed_keys(words, runs, base, packed)
        places = np.flatnonzero(words)
        order = places[np.argsort(keys[places], kind="stable")]
        self.keys = keys[order]
        rank = np.zeros(len(words) + 1, np.int64)
        slots = np.arange(len(order))
        tied = self._ranked(rank, order, slots, self.keys)
        known = packed
        while known < depth and tied.any():
            slots = slots[tied]
            slots = slots[runs[order[slots]] >= known]
            if not len(slots):
                break
            at = order[slots]
            pair = rank[at] * (len(words) + 2) + rank[np.minimum(at + known, len(words))]
            within = np.argsort(pair, kind="stable")
            order[slots] = at[within]
            tied = self._ranked(rank, order[slots], slots, pair[within])
            known *= 2
        self.order = order

    @staticmethod
    def _ranked(rank: np.ndarray, at: np.ndarray, slots: np.ndarray, keys: np.ndarray):
        """Rank places by the first slot of their key; returns which keys are not alone."""
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1] + 1
        return ~(new & np.append(new[1:], True)[: len(new)])

    def border(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool):
        """First slot in ``[low, high)`` whose word at ``depth`` is not below (or is above) ``word``.

        All suffixes of a range share their first ``depth`` words.
        """
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            found = self.words[np.minimum(self.order[middle] + depth, len(self.words) - 1)]
            below = found <= word[open_] if after else found < word[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


def search(array: SuffixArray, items: Benchmark) -> tuple[np.ndarray, ...]:
    """Where every benchmark suffix lies in a suffix array.

    Returns ``low`` and ``high``, the slots that share the suffix's window (none where
    ``items.width`` is 0), and the ``length`` and a ``place`` of its longest match.
    """
    count, packed = len(items.suffix), items.packed
    low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
    length, place = np.zeros(count, np.int64), np.zeros(count, np.int64)
    room = items.base ** np.arange(packed + 1, dtype=np.int64)

    def heads(which: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that share the first ``size`` words, no more than a key holds."""
        cut = room[packed - size]
        floor = items.keys[items.suffix[which]] // cut * cut
        return np.searchsorted(array.keys, floor), np.searchsorted(array.keys, floor + cut - 1, "right")

    short = np.flatnonzero((items.width > 0) & (items.width <= packed))
    low[short], high[short] = heads(short, items.width[short])
    for k in range(packed, 0, -1):
        wanted = (items.needed <= k) | (k == packed)
        pending = np.flatnonzero((length == 0) & (items.left >= k) & wanted)
        if not len(pending):
            continue
        a, b = heads(pending, np.full(len(pending), k))
        there = b > a
        length[pending[there]], place[pending[there]] = k, array.order[a[there]]
    now = np.flatnonzero(length == packed)
    a, b = heads(now, np.full(len(now), packed))
    depth = packed
    while len(now):
        more = items.left[now] > depth
        now, a, b = now[more], a[more], b[more]
        word = items.stream[items.suffix[now] + depth]
        a, b = array.border(a, b, depth, word, False), array.border(a, b, depth, word, True)
        more = b > a
        now, a, b, depth = now[more], a[more], b[more], depth + 1
        length[now], place[now] = depth, array.order[a]
        at_window = items.width[now] == depth
        low[now[at_window]], high[now[at_window]] = a[at_window], b[at_window]
    return low, high, length, place


def matches(texts: list[bytes], items: Benchmark, window: int) -> list[tuple]:
    """``(n_words, spans, item ids, longest matches)`` of each document of a shard.

    Spans are the hit words as ``(start, end)``; longest matches, one for each item whose
    longest match in the shard begins in the document, ``(item_id, item_start, start, length)``.
    """
    get, parts, sizes = items.vocabulary.get, [], []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
        sizes.append(len(words))
    rows: list[tuple] = [(n, [], set(), []) for n in sizes]
    if not len(items.suffix) or not rows:
        return rows
    start = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    shard = np.concatenate(parts)
    array = SuffixArray(shard, items.base, items.packed, items.longest)
    low, high, length, place = search(array, items)

    counts = np.maximum(high - low, 0)
    suffix = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[suffix]
    at = array.order[slot]
    size = len(shard) + 1
    edges = np.bincount(at, minlength=size) - np.bincount(at + items.width[suffix], minlength=size)
    hit = np.concatenate([[False], np.cumsum(edges) > 0])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    begins, ends = turns[::2], turns[1::2]
    doc = np.searchsorted(start, begins, "right") - 1
    for d, a, b in zip(doc.tolist(), begins - start[doc], ends - start[doc], strict=True):
        rows[d][1].append((int(a), int(b)))

    holder = np.searchsorted(start, at, "right") - 1
    for d, s in np.unique(np.stack([holder, suffix], 1), axis=0).tolist():
        rows[d][2].update(items.items_of(s))

    # Of each item the longest match, at its first place in the item.
    best = np.lexsort((items.suffix, -length, items.item))
    best = best[np.append(True, items.item[best][1:] != items.item[best][:-1])]
    for s in best[length[best] >= items.needed[best]].tolist():
        d = int(np.searchsorted(start, place[s], "right")) - 1
        begin = int(place[s] - start[d])
        rows[d][3].append((items.ids[items.item[s]], int(items.item_start[s]), begin, int(length[s])))
    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def shards(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Runs of documents of about ``size`` bytes."""
    part: list[bytes] = []
    room = size
    for text in texts:
        part.append(text)
        room -= len(text) + 1
        if room <= 0:
            yield part
            part, room = [], size
    if part:
        yield part


def _item_blocks(benchmark: DataFrame, p: Search) -> Iterator[list[tuple[Any, bytes]]]:
    """Items in lists of at most ``block_bytes`` of text or one item; at least one list.

    Sizes are known before any text comes to the driver.
    """
    rows = settled(
        benchmark.select("item_id", F.encode("text", "UTF-8").alias("text"))
        .where(F.octet_length("text") > 0)
        .withColumn("_at", F.monotonically_increasing_id())
    ).table
    size = F.octet_length("text")
    whole = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-2 * whole // p.block_bytes))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_at"), F.lit(parts)))
    long = size > p.block_bytes // 2
    sizes = rows.where(~long).groupBy("_part").agg(F.sum(size).alias("n")).orderBy("_part")
    groups, room = [[]], p.block_bytes
    for part, n in sizes.collect():
        if groups[-1] and n > room:
            groups.append([])
            room = p.block_bytes
        groups[-1].append(part)
        room -= n
    alone = [r["_at"] for r in rows.where(long).select("_at").orderBy("_at").toLocalIterator()]
    chosen = [~long & F.col("_part").isin(g) for g in groups if g]
    chosen += [F.col("_at") == at for at in alone]
    for choice in chosen or [F.lit(False)]:
        yield [(r["item_id"], bytes(r["text"])) for r in rows.where(choice).orderBy("_at").collect()]


def searched(
    documents: DataFrame, benchmark: DataFrame, p: Search = Search(), found: str = "_found"
) -> DataFrame:
    """``documents`` and a struct ``found`` of ``n_words``, ``spans``, ``items``, ``longest``."""
    item_id = benchmark.schema["item_id"].dataType.simpleString()
    arrow_id = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    numbers = ("item_start", "start", "length")
    places = ", ".join(f"{n}: bigint" for n in numbers)
    record = (
        "n_words: bigint, spans: array<struct<start: bigint, end: bigint>>,"
        f" items: array<{item_id}>, longest: array<struct<item_id: {item_id}, {places}>>"
    )
    added = T.StructType.fromDDL(f"added struct<{record}>").fields[0].dataType
    schema = T.StructType([*documents.schema.fields, T.StructField(found, added)])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    place = pa.struct([("item_id", arrow_id), *((n, pa.int64()) for n in numbers)])
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(span)),
            ("items", pa.list_(arrow_id)),
            ("longest", pa.list_(place)),
        ]
    )

    def row(n: int, spans: list, ids: set, longest: list, earlier: dict | None) -> dict:
        longest = [dict(zip(("item_id", *numbers), m, strict=True)) for m in longest]
        if earlier:
            spans = merged([*spans, *((x["start"], x["end"]) for x in earlier["spans"])])
            ids, longest = ids.union(earlier["items"]), earlier["longest"] + longest
        spans = [{"start": a, "end": b} for a, b in spans]
        return {"n_words": n, "spans": spans, "items": list(ids), "longest": longest}

    def add(df: DataFrame, items: list[tuple[Any, bytes]]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shared.value, p.window)
            for batch in batches:
                texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
                rows = [x for part in shards(texts, p.shard_bytes) for x in matches(part, index, p.window)]
                before = [None] * len(rows)
                if found in batch.schema.names:
                    before = batch.column(found).to_pylist()
                    batch = batch.drop_columns([found])
                new = [row(*x, earlier) for x, earlier in zip(rows, before, strict=True)]
                yield batch.append_column(found, pa.array(new, kind))

        return df.mapInArrow(run, schema)

    out = documents
    for k, items in enumerate(_item_blocks(benchmark, p)):
        out = add(settled(out).table if k else out, items)
    return out


def n_hit(found: str = "_found") -> Column:
    """Hit words of a document."""
    spans = F.transform(F.col(found)["spans"], lambda s: s["end"] - s["start"])
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)


def decontamination(
    documents: DataFrame, benchmark: DataFrame, p: Search = Search()
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row per document."""
    hits = searched(documents.select("doc_id", "text"), benchmark, p)
    known = F.filter(F.col("_found")["items"], lambda i: i.isNotNull())
    named = F.array_sort(F.transform(known, lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        F.col("_found")["n_words"].alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(known).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.size(F.col("_found")["spans"]) > 0).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """Documents without a benchmark window; columns stay as they are."""
    found = "_found"
    while found in documents.columns:
        found += "_"
    clean = searched(documents, benchmark, p, found).where(F.size(F.col(found)["spans"]) == 0)
    return clean.select(*map(cell, documents.columns))


def longest_matches(documents: DataFrame, benchmark: DataFrame, p: Search = Search()) -> DataFrame:
    """``(item_id, length, doc_id, start, item_start)``: the longest verbatim match of each item.

    Lengths and starts are words. Of several longest matches one is given: that in the
    smallest ``doc_id``. Items without a match of a whole window have no row.
    """
    hits = searched(documents.select("doc_id", "text"), benchmark, p)
    every = hits.select("doc_id", F.inline(F.col("_found")["longest"]))
    place = F.struct((-F.col("length")).alias("_n"), "doc_id", "start", "item_start")
    best = every.groupBy("item_id").agg(F.min(place).alias("_m"))
    return best.select("item_id", (-F.col("_m._n")).alias("length"), "_m.doc_id", "_m.start", "_m.item_start")
