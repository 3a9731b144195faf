"""Centroid clustering over zone maps in the order of a space-filling curve.

Vectors become integers on a grid and are written once in the order of a Hilbert curve
over the coordinates that vary most, in blocks of ``block`` vectors that each keep the
smallest and largest value of every coordinate and the sum of their vectors. In each
round a block is first compared with the centroids through its box: a centroid that is further than
another one from every point of the box cannot win any vector of the block. Only the
candidates that are left are compared with the vectors,
exactly; where one is left, the block's sum is added without looking at them.

All arithmetic is on integers. A round reads the blocks and returns one row of sums for
each centroid and task; centroids are the only thing that a round hands to the next. Rows
are dealt to blocks by curve position and a hash, so a vector that a third of the table
repeats fills many blocks.

Defined results: only vectors of exactly ``dim`` components, none null or non-finite, are
kept; the others have no row. Rows are vectors: repeated rows and ids are clustered one
by one. Seeds are the rows with the smallest hash, equal ones by their components, and
rows without an id come last; with fewer rows than ``clusters`` there are fewer centroids. A grid
coordinate of 2 ** 27 or more fails the query, as distances would not fit 64 bits.
Columns besides ``vec_id`` and ``embedding`` are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collidera.sources.shared_folder import settled

#: Bound of grid coordinates: sums of 64 products of differences fit 64 bits.
GRID = 1 << 27
#: Below it all products and their sums are exact in doubles.
EXACT = 1 << 22


@dataclass(frozen=True)
class Clustering:
    """Parameters of the result, then of the layout, which no result depends on."""

    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: int = 3
    block: int = 256
    curve_dims: int = 12
    curve_bits: int = 5


def whole_vector(dim: int, embedding: str = "embedding") -> Column:
    """Whether a vector has ``dim`` components, all of them finite."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def on_grid(embeddings: DataFrame, p: Clustering) -> DataFrame:
    """``(vec_id, v)``: the kept vectors as integers."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * p.scale)
    fits = F.forall(scaled, lambda x: F.abs(x) < GRID)
    error = F.raise_error(F.lit(f"embedding: a component is {GRID // p.scale} or more"))
    v = F.when(fits, F.transform(scaled, lambda x: F.floor(x).cast("int"))).otherwise(error)
    kept = embeddings.where(whole_vector(p.dim))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Vectors of a batch, one in each row."""
    return batch.column("v").flatten().to_numpy().reshape(-1, dim)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates below ``2 ** bits``, by row.

    The coordinates are turned into the transposed Gray code of the curve, one bit plane
    after the other from the top; their bits, taken in turns, make the key.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        high, low = 1 << plane, (1 << plane) - 1
        for i in range(dims):
            turned = (x[i] & high) != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swapped)
            x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> plane & 1)
    return key


def curve_layout(grid: DataFrame, p: Clustering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates that vary most, their lowest values and the widths of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch, p.dim)
            if len(v):
                x = v.astype(np.float64)
                columns = (np.arange(p.dim), np.full(p.dim, len(v)), x.sum(0), (x * x).sum(0), v.min(0), v.max(0))
                kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["at", "n", "s", "ss", "low", "high"],
                )

    schema = "at int, n long, s double, ss double, low long, high long"
    mean = F.sum("s") / F.sum("n")
    found = grid.select("v").mapInArrow(run, schema).groupBy("at").agg(
        (F.sum("ss") / F.sum("n") - mean * mean).alias("spread"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    rows = sorted(found.collect(), key=lambda r: (-r["spread"], r["at"]))[: p.curve_dims]
    at, low, high = (np.array([r[c] for r in rows], np.int64) for c in ("at", "low", "high"))
    return at, low, np.maximum(1, -(-(high - low + 1) >> p.curve_bits))


BLOCK_SCHEMA = "ids array<long>, v binary, low binary, high binary, sums binary"


def zone_maps(grid: DataFrame, p: Clustering) -> DataFrame:
    """Blocks of vectors in curve order with their boxes and sums, a row for each."""
    at, lowest, width = curve_layout(grid, p)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (matrix(batch, p.dim)[:, at] - lowest) // width
            yield batch.append_column("_key", pa.array(hilbert_keys(cells, p.curve_bits)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, p.block):
                part = batch.slice(k, p.block)
                v = matrix(part, p.dim).astype("<i4")
                low, high, sums = v.min(0), v.max(0), v.sum(0, dtype="<i8")
                rows.append((part.column("vec_id").to_pylist(), *(x.tobytes() for x in (v, low, high, sums))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.list_(pa.int64())] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["ids", "v", "low", "high", "sums"],
            )

    # Copies stand side by side, and the salt cuts them wherever a range is full.
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("_salt")
    places = grid.mapInArrow(keyed, "vec_id long, v array<int>, _key long")
    places = places.select("vec_id", "v", "_key", F.xxhash64("v").alias("_like"), salt)
    order = ["_key", "_like", "_salt"]
    ordered = places.repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(ordered.select("vec_id", "v").mapInArrow(blocks, BLOCK_SCHEMA)).table


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of a box, ties included.

    The difference of the distances to two centroids is linear in the point, so its bound
    over the box is taken at a corner, coordinate by coordinate.
    """
    squares = (centroids * centroids).sum(1)
    towards = centroids[:, None] - centroids[None]
    corner = np.maximum(towards * low, towards * high).sum(2)
    beyond = 2 * corner + squares[None] - squares[:, None]
    return np.flatnonzero((beyond >= 0).all(1))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each vector, and the squared distance."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        squares = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        distance = squares.astype(np.int64)
    else:
        distance = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(v)), best]


def opened(batch: pa.RecordBatch, dim: int, columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Matrices and boxes of the blocks of a batch, as 64-bit integers."""
    for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
        kinds = ["<i8" if c == "sums" else "<i4" for c in columns]
        found = [np.frombuffer(x, k).astype(np.int64) for x, k in zip(row, kinds, strict=True)]
        yield [x.reshape(-1, dim) if c == "v" else x for x, c in zip(found, columns, strict=True)]


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Per centroid that is nearest to any vector: how many, and the sums of their components."""
    count, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, dim + 1), np.int64)
        for batch in batches:
            for v, low, high, whole in opened(batch, dim, ("v", "low", "high", "sums")):
                able = candidates(low, high, centroids)
                if len(able) == 1:
                    sums[able[0], 0] += len(v)
                    sums[able[0], 1:] += whole
                    continue
                own = able[nearest(v, centroids[able])[0]]
                np.add.at(sums[:, 0], own, 1)
                for k in able:
                    sums[k, 1:] += v[own == k].sum(0)
        used = np.flatnonzero(sums[:, 0])
        values = pa.array(sums[used].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), values], ["cluster", "s"])

    partial = blocks.select("v", "low", "high", "sums").mapInArrow(run, "cluster int, s array<long>")
    cells = partial.select("cluster", F.posexplode("s"))
    found = cells.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    rows: dict[int, list[int]] = {}
    for r in found.orderBy("cluster", "pos").collect():
        rows.setdefault(r["cluster"], []).append(int(r["s"]))
    return rows


def seeds(grid: DataFrame, p: Clustering) -> np.ndarray:
    """Vectors of the rows with the smallest hashes."""
    order = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    first = grid.orderBy(order.asc_nulls_last(), "v").limit(p.clusters).select("v").collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, p.dim)


def fitted(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after some rounds; means are rounded down, empty clusters stay."""
    centroids = centroids.copy()
    for _ in range(rounds):
        for k, (n, *sums) in cluster_sums(blocks, centroids).items():
            centroids[k] = [s // n for s in sums]
    return centroids


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for v, low, high in opened(batch, dim, ("v", "low", "high")):
                able = candidates(low, high, centroids)
                own, distance = nearest(v, centroids[able])
                clusters.append(able[own])
                distances.append(distance)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ids").flatten(),
                    pa.array(np.concatenate(clusters), pa.int32()),
                    pa.array(np.concatenate(distances)),
                ],
                names=["vec_id", "cluster", "distance"],
            )

    columns = blocks.select("ids", "v", "low", "high")
    return columns.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clustering(embeddings: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``."""
    spark = embeddings.sparkSession
    grid = settled(on_grid(embeddings, p)).table
    first = seeds(grid, p)
    blocks = zone_maps(grid, p)
    centroids = fitted(blocks, first, p.rounds) if len(first) else first
    found = settled(assigned(blocks, centroids)).table
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}
    whole = sum(inertia.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, inertia[k], whole, names[k]) for k in sorted(inertia)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # A row for each centroid.
    return found.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
