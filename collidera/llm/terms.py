"""Hashed terms of whole texts, shared by the trained document scorers.

A term is a run of letters, digits and underscores, or a run of other visible
characters, in lower case. Terms are hashed into ``2 ** bits`` columns; no
vocabulary is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = re.compile(r"\w+|[^\w\s]+")

#: Hash of a pair of equal neighbours, whatever the term is.
SAME_PAIR = 0x5BD1E995
MEMO_TERMS = 300_000


class TermHashes(dict):
    """Hashes of terms seen so far, forgotten when they become too many."""

    def __missing__(self, term: str) -> int:
        value = xxhash.xxh32_intdigest(term.encode("utf-8", "surrogatepass"))
        self[term] = value
        return value

    def of(self, text: str) -> np.ndarray:
        if len(self) > MEMO_TERMS:
            self.clear()
        found = TERM.findall(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def neighbour_pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring terms taken together."""
    left, right = hashes[:-1], hashes[1:]
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(left == right, np.uint64(SAME_PAIR), mixed ^ (mixed >> np.uint64(29)))


def folded(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Columns of hashes, from all of their bits."""
    spread = hashes * np.uint64(0xD6E8FEB86659FD93)
    return (spread >> np.uint64(64 - bits)).astype(np.int64)


#: Columns and values of the terms of one text.
Features = Callable[[str, TermHashes], tuple[np.ndarray, np.ndarray]]


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, admitted: Column, rows: int, seed: int
) -> DataFrame:
    """``(key, text, label)`` of at most ``rows`` labelled documents, the same every time.

    Rows are drawn by a seeded hash of ``doc_id`` from those that ``admitted`` allows
    and whose label is 0 or 1; a null text counts as empty. Only ids pass through the
    draw, so the texts of all other documents stay where they are. Repeated rows of a
    drawn document count once per text.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    drawn = (
        labels.filter(admitted & F.col(label).isin(0, 1))
        .select("doc_id", F.col(label).cast("int").alias("label"), key.alias("key"))
        .distinct()
        .orderBy("key", "doc_id", "label")
        .limit(rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("key", "text", "label")


def sample_features(sample: DataFrame, features: Features) -> DataFrame:
    """``(key, label, columns, values)`` of a sample, taken where its texts lie."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            pairs = [features(t, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("label"),
                    pa.array([c.astype(np.int32).tobytes() for c, _ in pairs], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in pairs], pa.binary()),
                ],
                names=["key", "label", "columns", "values"],
            )

    schema = "key long, label int, columns binary, values binary"
    return sample.mapInArrow(taken, schema)


def trained(sample: DataFrame, rows: int, train: Callable[[list], bytes]) -> bytes:
    """What ``train`` makes of a sample of at most ``rows`` examples, in one task.

    The examples are a list of ``(label, columns, values)`` in the order of the draw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [
            (y, np.frombuffer(c, np.int32), np.frombuffer(v, np.float32))
            for batch in batches
            for _, y, c, v in zip(*(x.to_pylist() for x in batch.columns), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([train(examples)], pa.binary())], ["model"])

    ordered = sample.orderBy("key", "label", "columns").limit(rows).coalesce(1)
    return bytes(ordered.mapInArrow(run, "model binary").first()["model"])


#: Made once in each task: the scorer of one text.
Scorer = Callable[[], Callable[[str], float]]


def with_score(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``df`` and a column ``_score`` of its ``text``, a null one taken as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            values = [of(t or "") for t in batch.column("text").to_pylist()]
            yield batch.append_column("_score", pa.array(values, pa.float64()))

    schema = T.StructType([*df.schema.fields, T.StructField("_score", T.DoubleType())])
    return df.mapInArrow(run, schema)


def kept_by_score(df: DataFrame, scorer: Scorer, keep: Callable[[float], bool]) -> DataFrame:
    """Rows of ``df`` whose score ``keep`` accepts; columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer()
        for batch in batches:
            kept = [keep(of(t or "")) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def hash_part(column: str, parts: int) -> Column:
    """CRC32 of an id's text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def sigmoid(z: float) -> float:
    """Logistic function without overflow."""
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))
