"""Near-duplicate vectors: int8 tile products with rigorous error bounds.

Each unit vector ``x`` is kept as ``x' = scale * q`` with 8-bit integers ``q`` and the
exact length ``e`` of ``x - x'``. For two vectors, by Cauchy and Schwarz,
``|x.y - x'.y'| <= |x'| * e_y + e_x``. Products of integer tiles therefore settle most
pairs; only pairs whose interval holds the threshold are computed again in doubles.
Integers are multiplied as 32-bit floats in slices of at most 1024 columns, in which
every partial sum is exact.

Copies are one class with a count and are never paired. A task compares two blocks of
classes and returns, per class, how many vectors it links to and a local root, so its
output does not grow with the number of links. Vectors travel as they are stored; tasks
make the integers themselves.

Defined results: null and zero vectors, and those with null or non-finite components,
link with nothing; so do vectors of different length. Rows are vectors: repeated rows
are separate vectors that link to each other, and rows that share an id but not the vector
are linked apart. A null ``vec_id`` takes no part in naming a component, though its vector
links like any other, and its own row has ``kept`` false. Columns besides ``vec_id`` and
``embedding`` are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.llm.components import components
from collidera.llm.skew import lookup
from collidera.sources.shared_folder import settled

#: Vectors of a block, so a task holds two of them; and of a tile within it.
BLOCK = 4096
TILE = 1024
#: Room for the rounding of 32-bit products with their scales.
SLACK = 1e-5


def usable(embedding: str = "embedding"):
    """Whether a vector can link: finite components, not all zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers, scales, lengths of the approximations and of their errors, by row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles, without overflow on the way."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``size`` nodes over links ``a - b``."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def tile_links(
    left: dict[str, np.ndarray], right: dict[str, np.ndarray], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two tiles that link, as places in both.

    The tiles' largest error leaves few pairs open; those have a bound of their own, and
    what that leaves open is computed in doubles.
    """
    products = np.zeros((len(left["scale"]), len(right["scale"])), np.float32)
    for k in range(0, left["codes"].shape[1], 1024):
        products += left["codes"][:, k : k + 1024] @ right["codes"][:, k : k + 1024].T
    widest = left["length"].max() * right["error"].max() + left["error"].max() + SLACK
    products *= right["scale"].astype(np.float32)
    least = ((threshold - widest) / left["scale"]).astype(np.float32)
    i, j = np.nonzero(products >= least[:, None])
    near = products[i, j] * left["scale"][i]
    bound = left["length"][i] * right["error"][j] + left["error"][i] + SLACK
    linked = near - bound >= threshold
    open_ = np.flatnonzero((near + bound >= threshold) & ~linked)
    for k in range(0, len(open_), 1 << 16):
        at = open_[k : k + (1 << 16)]
        linked[at] = np.einsum("ij,ij->i", left["unit"][i[at]], right["unit"][j[at]]) >= threshold
    return i[linked], j[linked]


def block_pair(key: tuple, table: pa.Table, threshold: float) -> pa.Table:
    """``(class, links, root)`` of the classes of one or two blocks that link across them.

    The key names both blocks: a pair of which one block has no vector has no links.
    """
    dim, low, high = (k.as_py() for k in key)
    table = table.sort_by([("block", "ascending"), ("class", "ascending")])
    size, block = len(table), table.column("block").to_numpy()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    unit = unit_vectors(flat.reshape(size, dim))
    codes, scale, length, error = quantised(unit)
    whole = {
        "unit": unit,
        "codes": codes.astype(np.float32),
        "scale": scale,
        "length": length,
        "error": error,
    }
    n, one = table.column("n").to_numpy(), low == high
    split = size if one else int(np.searchsorted(block, high))
    links, stars = np.zeros(size, np.int64), []
    for s in range(0, split, TILE):
        rows = np.arange(s, min(s + TILE, split))
        for t in range(s if one else split, size, TILE):
            columns = np.arange(t, min(t + TILE, size))
            i, j = tile_links(
                {k: v[rows] for k, v in whole.items()},
                {k: v[columns] for k, v in whole.items()},
                threshold,
            )
            if one and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(links, s + i, n[t + j])
                np.add.at(links, t + j, n[s + i])
                root = local_roots(len(rows) + len(columns), i, j + len(rows))
                names = np.concatenate([rows, columns])
                moved = root != np.arange(len(root))
                stars.append((names[moved], names[root[moved]]))
    a, b = ([np.zeros(0, np.int64), *(s[k] for s in stars)] for k in (0, 1))
    root = local_roots(size, np.concatenate(a), np.concatenate(b))
    name, hit = table.column("class").to_numpy(), links > 0
    # A local component is named by its first class, not yet by its smallest id.
    return pa.table({"class": name[hit], "links": links[hit], "root": name[root[hit]]})


def embedding_links(
    classes: DataFrame, total: int, threshold: float, block: int = BLOCK
) -> DataFrame:
    """``(class, links, root)`` of all block pairs; a class occurs once per pair it links in."""
    blocks = max(1, -(-total // block))
    own = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    paired = classes.select("class", "n", "dim", "embedding", own.alias("block")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keyed = paired.withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return block_pair(key, table, threshold)

    return keyed.groupBy("dim", "low", "high").applyInArrow(run, "class long, links long, root long")


def embedding_dedup(
    embeddings: DataFrame, threshold: float = 0.95, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = settled(rows.filter(usable()))
    classes = settled(
        valid.table.groupBy("embedding")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("n"),
            F.size("embedding").alias("dim"),
        )
        .withColumn("class", F.monotonically_increasing_id())
    )
    parts = settled(embedding_links(classes.table, classes.rows, threshold, block)).table
    links = parts.groupBy(F.col("class").alias("of")).agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("class").alias("u"), F.col("root").alias("v")))
    placed = settled(
        classes.table.join(links, F.col("class") == F.col("of"), "left")
        .join(roots, F.col("class") == F.col("node"), "left")
        .select(
            "embedding",
            "rep",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "class").alias("component"),
            F.col("n").alias("copies"),
        )
    )
    # A component is named by its smallest id, whichever class that stands in.
    named = settled(
        placed.table.groupBy("component").agg(
            F.min("rep").alias("component_id"), F.count("*").alias("_n")
        )
    ).table
    found = settled(
        lookup(placed.table, named, "component", placed.rows).select(
            "embedding", "n_links", "component_id", F.col("copies").alias("_n")
        )
    ).table
    linked = lookup(valid.table, found, "embedding", valid.rows).select(
        "vec_id", "n_links", "component_id"
    )
    alone = rows.filter(~usable()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
