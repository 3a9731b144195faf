"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collidera.llm.skew import lookup
from collidera.sources.shared_folder import Settled, settled


def _minima(links: DataFrame) -> DataFrame:
    """Smallest neighbour and number of neighbours of each ``u`` in ``(u, v)``."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))


def _with_minima(links: Settled) -> DataFrame:
    return lookup(links.table, settled(_minima(links.table)).table, "u", links.rows)


def _larger_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` is linked to the smallest of ``u`` and its neighbours."""
    both = settled(links.union(links.select("v", "u")))
    found = _with_minima(both).filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _smaller_star(links: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours are linked to the smallest of them."""
    kept = settled(links)
    minima = settled(_minima(kept.table)).table
    found = lookup(kept.table, minima, "u", kept.rows).filter("v > m")
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return minima.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(u, v)`` that is not the smallest of its component.

    Nodes are of one orderable type; null ends, loops and repeated links are ignored, so
    an empty table gives an empty one. The number of rounds grows with the logarithm of
    the largest component; each is written to the shared folder, links are never
    collected, and nodes with very many neighbours are spread over tasks.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = settled(
        links.filter("u is not null and v is not null and u <> v")
        .select(u.alias("u"), v.alias("v"))
        .distinct()
    )
    seen = None
    while now.rows:
        mark = now.table.agg(F.bit_xor(F.xxhash64("u", "v")), F.count("*")).first()
        if mark == seen:
            break
        seen = mark
        now = settled(_smaller_star(_larger_star(now.table)))
    return now.table.select(F.col("u").alias("node"), F.col("v").alias("root"))
