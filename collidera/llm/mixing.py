"""Mixing sources to target weights: blocks of equal words, apportioned by Sainte-Laguë.

Every source's documents are dealt to shards by a seeded hash and laid end to end in a
seeded order, twice, so that nothing is taken more than twice. Each shard's stream is
cut into blocks of ``block`` words. The mix is a number of blocks: sources get them by
highest quotients ``target / (2 k + 1)``, and a source's blocks go to its shards in the
same way by their sizes. Within a shard, the blocks to take are spread evenly over the
stream from a seeded start, and a document's share is what its words have in common
with them; that is a closed formula, so no block is ever a row.

Shards hold about ``shard_rows`` documents of one source, so a source that holds most
rows is many groups. Apportioning handles a few candidate seats per source or shard,
never all of them.

Defined results: a null text has size 0 and takes nothing; null is a source of its own,
ordered last; a null id is dealt like an empty one; equal rows may swap their places but
not their sum; an empty table gives an empty one. Documents that share an id share a
shard, unless the id is so common that its rows are dealt one by one. Columns besides ``doc_id``, ``source`` and ``text`` are ignored. Everything is
built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.llm.skew import PARTS
from collidera.sources.shared_folder import Settled, settled

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Parameters: ``share`` of all words is taken, at most ``epochs`` times each."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    epochs: int = 2
    block: int = 16
    shard_rows: int = 4096
    seed: str = "mix"


def word_count(text: str = "text") -> Column:
    """Words of a whole text; 0 for a null one."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))), F.lit(0))


def seeded(*parts: Column | str) -> Column:
    """A number below ``2 ** 32`` from the MD5 of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``target`` to ``(key, source, source_size)``.

    Weights share the mix; a source that would get more than ``epochs`` times its size
    gets just that, and the rest is shared again. With sources in the order of their cap
    per weight, that is one pass: the first that stays below its cap fixes the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(mix.weights)
    weight = F.array(*map(F.lit, mix.weights))[place].cast("double")
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    known = sources.select(
        "*", weight.alias("_w"), (F.lit(float(mix.epochs)) * F.col("source_size")).alias("_cap")
    ).select(
        "*",
        (F.lit(mix.share) * F.sum("source_size").over(every)).alias("_all"),
        F.sum("_w").over(every).alias("_ws"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_fw"),
    )
    level = (F.col("_all") - F.col("_full")) / (F.col("_ws") - F.col("_fw"))
    fits = F.col("_cap") / F.col("_w")
    free = F.when(fits > level, F.struct(fits, "key", level))
    found = known.withColumn("_level", F.min(free).over(every)["col3"])
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return found.select("key", "source", "source_size", target.alias("target"))


def apportioned(parts: DataFrame, group: list[str], key: str, weight: str, seats: str, cap: str):
    """``parts`` with ``quota``: the ``seats`` of each group by highest quotients.

    A part gets its ``k``-th seat at ``weight / (2 k - 1)``, never more than ``cap``. Far
    below its exact share a part surely has its seats, far above it has none, so only
    seats near the share compete; together they are a few times the number of parts.
    """
    own = Window.partitionBy(*group)
    share = F.coalesce(F.try_divide(weight, F.sum(weight).over(own)), F.lit(0.0))
    reach = share * (2 * F.count("*").over(own)) + 2
    placed = parts.withColumns(
        {
            "_low": F.greatest(F.lit(0.0), F.least(cap, F.floor(F.col(seats) * share - reach))),
            "_high": F.greatest(F.lit(0.0), F.least(cap, F.ceil(F.col(seats) * share + reach))),
        }
    ).withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("_low", "_high")})
    placed = placed.withColumn("_left", F.col(seats) - F.sum("_low").over(own))
    rivals = placed.select(
        *group,
        key,
        weight,
        "_left",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_high") - F.col("_low"))).alias("_step"),
        (F.col("_low") + F.col("_step")).alias("_k"),
        "_high",
    ).filter("_k < _high")
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    best = Window.partitionBy(*group).orderBy(F.desc(quotient), key, "_k")
    won = (
        rivals.withColumn("_rank", F.row_number().over(best))
        .filter("_rank <= _left")
        .groupBy(*group, key)
        .agg(F.count("*").alias("_won"))
    )
    return (
        placed.join(won, [*group, key], "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_low", "_high", "_left", "_won")
    )


def spread(docs: Settled, mix: Mix) -> DataFrame:
    """``docs`` with a draw ``_h`` of its own for each row of an id that very many rows have.

    Such ids, the missing one among them, have more than ``shard_rows`` rows and a
    ten-thousandth of all, so they are few. Their rows are dealt by text; equal rows by
    their number among their equals, which is made of the number in a part of the table
    and the rows in the parts before. Whatever the parts are, equal rows so get the
    numbers from 0, and reruns agree.
    """
    most = max(mix.shard_rows, docs.rows / PARTS)
    hot = docs.table.groupBy("_named").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = settled(hot.select("_named"))
    if not hot.rows:
        return docs.table
    few = F.broadcast(hot.table)
    same = ["_named", "key", "_text"]
    part = F.shiftright(F.monotonically_increasing_id(), 33).alias("_part")
    mine = docs.table.select("*", part, F.monotonically_increasing_id().alias("_at"))
    mine = settled(mine.join(few, "_named", "left_semi")).table
    counts = mine.groupBy(*same, "_part").agg(F.count("*").alias("_own"))
    upto = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(
        *[F.col(c).alias(f"{c}_of") for c in (*same, "_part")],
        (F.sum("_own").over(upto) - F.col("_own")).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_at")) - 1
    joined = mine.withColumn("_place", inside).join(
        starts, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*same, "_part")]
    )
    number = (F.col("_start") + F.col("_place")).cast("string")
    draw = seeded(F.lit(mix.seed), "_named", F.col("_text").cast("string"), number)
    dealt = joined.withColumn("_h", draw).select(docs.table.columns)
    return docs.table.join(few, "_named", "left_anti").select(docs.table.columns).unionByName(dealt)


def mix_plan(documents: DataFrame, mix: Mix = Mix(), row: str | None = None) -> DataFrame:
    """``(doc_id, size, source, source_size, target, place, cell, blocks, quota, start)``.

    ``place`` is where a document begins in its shard's stream of ``cell`` words; of the
    ``blocks`` of the doubled stream ``quota`` are taken, evenly from ``start``. ``row``
    names a column that tells rows apart; it orders equal rows and comes first.
    """
    rows = [row] if row else []
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = settled(
        documents.select(
            *rows,
            "doc_id",
            "source",
            word_count().cast("long").alias("size"),
            key.alias("key"),
            named.alias("_named"),
            F.xxhash64("text").alias("_text"),
            seeded(F.lit(mix.seed), named).alias("_h"),
        )
    )
    docs = spread(docs, mix).drop("_named", "_text")
    sources = docs.groupBy("key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.ceil(F.count("*") / mix.shard_rows).alias("_shards"),
    )
    sources = settled(sources).table
    dealt = docs.join(sources.select("key", "_shards"), "key").withColumn(
        "shard", F.col("_h") % F.col("_shards")
    ).drop("_shards")
    cells = dealt.groupBy("key", "shard").agg(F.sum("size").alias("cell"))
    cells = cells.withColumn("blocks", F.ceil(F.lit(mix.epochs) * F.col("cell") / mix.block))
    supply = cells.groupBy("key").agg(F.sum("blocks").alias("supply"))
    aimed = targets(sources.drop("_shards"), mix).join(supply, "key")
    whole = F.round(F.sum("target").over(Window.partitionBy()) / mix.block).cast("long")
    per_source = apportioned(
        aimed.withColumns({"_seats": whole, "_one": F.lit(0)}),
        ["_one"], "key", "target", "_seats", "supply",
    ).select("key", "source_size", "target", F.col("quota").alias("_seats"))
    start = seeded(F.lit(mix.seed), "key", F.col("shard").cast("string"))
    per_cell = apportioned(
        cells.join(per_source, "key"), ["key"], "shard", "cell", "_seats", "blocks"
    ).withColumn("start", start % F.greatest("blocks", F.lit(1)))
    order = Window.partitionBy("key", "shard").orderBy("_h", "doc_id", "size", *rows)
    place = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        dealt.withColumn("place", place)
        .join(per_cell.drop("_seats"), ["key", "shard"])
        .select(
            *rows, "doc_id", "size", "source", "source_size", "target",
            "place", "cell", "blocks", "quota", "start",
        )
    )


def taken_before(at: Column, mix: Mix) -> Column:
    """Words taken before a position of a doubled stream."""
    block = F.expr("1L") * F.floor(at / mix.block)

    def seats(j: Column) -> Column:
        return F.floor((j * F.col("quota") + F.col("start")) / F.greatest("blocks", F.lit(1)))

    inside = (at % mix.block) * (seats(block + 1) - seats(block))
    return seats(block) * mix.block + inside


def mixed(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: words the mix takes of each document."""
    taken = sum(
        taken_before(F.col("place") + F.col("size") + e * F.col("cell"), mix)
        - taken_before(F.col("place") + e * F.col("cell"), mix)
        for e in range(mix.epochs)
    )
    return mix_plan(documents, mix).select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def taken_spans(place: int, size: int, blocks: int, quota: int, start: int, block: int):
    """``(from, to)`` word spans of ``[place, place + size)`` that lie in taken blocks."""
    found: list[list[int]] = []
    for j in range(place // block, -(-(place + size) // block)):
        if ((j + 1) * quota + start) // blocks > (j * quota + start) // blocks:
            a, b = max(place, j * block), min(place + size, (j + 1) * block)
            if found and found[-1][1] == a:
                found[-1][1] = b
            else:
                found.append([a, b])
    return found


def mixed_texts(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``documents`` as the mix has them: one row for each pass that takes words of a text.

    A text is what the taken blocks hold of it, with the space between its words as it
    was; where blocks are left out in between, the parts are lines of their own. Columns
    stay as they are, ``n_chars`` follows the text if it is there. Every row has its own
    place in the mix, whatever its id: rows are numbered once, when they are settled.
    """
    names, where, row = documents.columns, "_mix", "_row"
    while {where, row} & set(names):
        where, row = f"{where}_", f"{row}_"
    numbered = settled(documents.withColumn(row, F.monotonically_increasing_id())).table
    plan = mix_plan(numbered, mix, row).filter("quota > 0 and size > 0").select(
        row, F.struct("place", "size", "cell", "blocks", "quota", "start").alias(where)
    )
    joined = numbered.join(plan, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [], []
            placed = (batch.column(c).to_pylist() for c in ("text", where))
            for i, (text, at) in enumerate(zip(*placed, strict=True)):
                for taken in passes_of(text, mix=mix, **at):
                    texts.append(taken)
                    rows.append(i)
            picked = batch.take(pa.array(rows, pa.int64())).select(names)
            new = picked.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                kind = picked.column("n_chars").type
                sizes = pa.array(map(len, texts), kind)
                new = new.set_column(names.index("n_chars"), "n_chars", sizes)
            yield new

    return joined.mapInArrow(run, documents.schema)


def passes_of(
    text: str, place: int, size: int, cell: int, blocks: int, quota: int, start: int, mix: Mix
) -> Iterator[str]:
    """What each pass over the stream takes of a text, if anything."""
    words = None
    for e in range(mix.epochs):
        first = place + e * cell
        spans = taken_spans(first, size, blocks, quota, start, mix.block)
        if spans == [[first, first + size]]:
            yield text
        elif spans:
            words = words or [m.span() for m in re.finditer(WORDS, text)]
            yield "\n".join(text[words[a - first][0] : words[b - first - 1][1]] for a, b in spans)


#: DuckDB statement for ``mixed`` with the default parameters.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size,
    ceil(count(*) / 4096.0)::BIGINT AS shards FROM docs GROUP BY key),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
    2.0::DOUBLE * source_size AS cap FROM sources),
filled AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(w) OVER () AS ws,
    coalesce(sum(cap) OVER o, 0) AS full_caps, coalesce(sum(w) OVER o, 0) AS fw
  FROM weighed
  WINDOW o AS (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (goal - full_caps) / (ws - fw) AS lvl FROM filled),
level AS (SELECT arg_min(lvl, (cap / w, key)) FILTER (cap / w > lvl) AS l FROM levels),
aimed AS (
  SELECT key, source_size, shards, least(cap, coalesce(l * w, cap)) AS target FROM levels, level),
dealt AS (SELECT d.*, h % shards AS shard FROM docs d JOIN sources USING (key)),
cells AS (SELECT key, shard, sum(size)::BIGINT AS cell, ceil(2 * sum(size) / 16.0)::BIGINT AS blocks
  FROM dealt GROUP BY key, shard),
supply AS (SELECT key, sum(blocks)::BIGINT AS supply FROM cells GROUP BY key),
seats AS (SELECT round(sum(target) / 16)::BIGINT AS n FROM aimed),
s_rank AS (
  SELECT key, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, key, k) AS r
  FROM aimed JOIN supply USING (key), LATERAL (SELECT unnest(range(supply)) AS k)),
s_quota AS (SELECT key, count(*) AS quota FROM s_rank, seats WHERE r <= n GROUP BY key),
c_rank AS (
  SELECT key, shard, row_number() OVER (
      PARTITION BY key ORDER BY cell::DOUBLE / (2 * k + 1) DESC, shard, k) AS r
  FROM cells, LATERAL (SELECT unnest(range(blocks)) AS k)),
c_quota AS (SELECT key, shard, count(*) AS quota FROM c_rank JOIN s_quota q USING (key)
  WHERE r <= q.quota GROUP BY key, shard),
placed AS (
  SELECT d.*, cell, greatest(blocks, 1) AS blocks, coalesce(quota, 0)::BIGINT AS quota,
    CAST('0x' || substr(md5('mix|' || key || '|' || shard), 1, 8) AS BIGINT)
      % greatest(blocks, 1) AS start,
    (sum(size) OVER (
      PARTITION BY key, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING
    ) - size)::BIGINT AS place
  FROM dealt d JOIN cells USING (key, shard) LEFT JOIN c_quota USING (key, shard)),
edges AS (
  SELECT *, unnest([place, place + size, place + cell, place + size + cell]) AS x,
    unnest([-1, 1, -1, 1]) AS sign FROM placed),
counted AS (
  SELECT *, (((x // 16) * quota + start) // blocks) * 16
    + (x % 16) * ((((x // 16) + 1) * quota + start) // blocks
      - ((x // 16) * quota + start) // blocks) AS before
  FROM edges)
SELECT c.doc_id, c.size, source_size, target, sum(sign * before)::BIGINT AS taken
FROM counted c JOIN aimed USING (key)
GROUP BY c.doc_id, c.size, source_size, target, c.key, c.place
"""
