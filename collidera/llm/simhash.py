"""Near-duplicate documents: SimHash fingerprints and multi-index hashing.

A fingerprint has a bit where over half of the text's shingle hashes have it. Two
fingerprints that differ in at most ``radius`` bits must be close in one of ``segments``
pieces, so every fingerprint looks up the small Hamming balls around its pieces in the
table of pieces, and each match is verified over all 64 bits.

Defined results: texts without a word, null ones too, have fingerprint zero and link
like any other; copies share a fingerprint and are never expanded into pairs; a null
``doc_id`` gets a fingerprint and a component, through which others are reached; a component
without any id has none. Columns besides ``doc_id``
and ``text`` are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.llm.components import components
from collidera.llm.skew import lookup
from collidera.sources.shared_folder import settled

SEED = 42
BITS = 64
WINDOW = 4


def fingerprint(text: str | None) -> int:
    """SimHash of the four-word shingles, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = max(1, len(words) - WINDOW + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:size].tolist()
    stops = ends[-size:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8"
    )
    counts = np.zeros(BITS, np.int64)
    for k in range(0, size, 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > size, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every document, computed where its text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, fp long")


def plan_of_segments(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """``(offset, width, ball radius)`` of each segment that has to be looked up.

    Were all of the first ``radius % segments + 1`` segments further apart than
    ``radius // segments`` and the others no closer than that, the whole would differ in
    more than ``radius`` bits.
    """
    ball, wider = divmod(radius, segments)
    found, offset = [], 0
    for k in range(segments):
        width = BITS // segments + (k < BITS % segments)
        own = ball if k <= wider else ball - 1
        if own >= 0:
            found.append((offset, width, own))
        offset += width
    return found


def ball_masks(width: int, radius: int) -> list[int]:
    """Patterns of at most ``radius`` changed bits among ``width``."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def close_pairs(distinct: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """``(a, b)``, ``a < b``: pairs of the column ``fp`` that differ in at most ``radius`` bits.

    Built-in expressions only. Joined rows are verified inside the join, so only true
    pairs leave it, some of them once per segment.
    """

    def piece(offset: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))

    def ball(segment: int, offset: int, width: int, own: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(width, own)])
        near = F.transform(masks, lambda m: piece(offset, width).bitwiseXOR(m))
        return F.transform(near, lambda k: F.struct(F.lit(segment).alias("s"), k.alias("k")))

    layout = list(enumerate(plan_of_segments(radius, segments)))
    keys = F.array(
        *[F.struct(F.lit(s).alias("s"), piece(o, w).alias("k")) for s, (o, w, _) in layout]
    )
    probes = F.flatten(F.array(*[ball(s, *segment) for s, segment in layout]))
    stored = distinct.select(F.col("fp").alias("b"), F.inline(keys))
    asked = distinct.select(F.col("fp").alias("a"), F.inline(probes))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    same_key = (asked["s"] == stored["s"]) & (asked["k"] == stored["k"])
    found = asked.join(stored, same_key & (F.col("a") < F.col("b")) & close)
    return found.select("a", "b").distinct()


def segments_for(prints: int) -> int:
    """Three segments, or two where a segment's keys would be shared by many fingerprints.

    Three make few probes that each meet ``prints / 2 ** 21`` others, two make 562 probes
    of 32 bits; the pairs are the same.
    """
    return 3 if prints <= 1 << 25 else 2


def simhash_groups(
    documents: DataFrame, radius: int = 4, segments: int | None = None
) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id reachable over close fingerprints."""
    prints = settled(fingerprints(documents))
    classes = settled(
        prints.table.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    )
    pairs = close_pairs(classes.table.select("fp"), radius, segments or segments_for(classes.rows))
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = settled(
        classes.table.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "rep", F.coalesce("root", "fp").alias("component"), F.col("n").alias("copies")
        )
    )
    # A component is named by its smallest id, whichever fingerprint has it.
    named = settled(
        placed.table.groupBy("component").agg(
            F.min("rep").alias("component_id"), F.count("*").alias("_n")
        )
    ).table
    found = settled(
        lookup(placed.table, named, "component", placed.rows).select(
            "fp", "component_id", F.col("copies").alias("_n")
        )
    ).table
    return lookup(prints.table, found, "fp", prints.rows)


def simhash_dedup(
    documents: DataFrame, radius: int = 4, segments: int | None = None
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, the fingerprint as 16 hexadecimal digits."""
    return simhash_groups(documents, radius, segments).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
