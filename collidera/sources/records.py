"""CSV records of large files, line breaks inside quotes included, read by many tasks.

A file is read as physical lines, split at byte ranges like any text file. Whether a
range begins inside a quoted cell follows from the number of quotes before it: doubled
quotes leave the parity as it is. So quotes are counted per range first, a running sum
over the ranges of a file tells each one its state, and every task then cuts its own
lines into records, starting at the first true border. What is left at the ends of
ranges, at most two pieces each, is put together apart.

Quotes are expected as CSV writers put them: around a whole cell, doubled inside. A file
with an odd number of quotes has no last border and is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collidera.sources.shared_folder import settled

#: Kinds of text that a range holds: whole records; the end, the begin and the middle of
#: one that other ranges share.
WHOLE, END, BEGIN, MIDDLE = range(4)

#: What the tasks are given, and what they return as whole records and as pieces.
LINES = ["range", "inside", "begin", "line"]
RECORDS = "first boolean, text string"
PIECES = "range long, kind int, first boolean, text string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, place, line)``: physical lines; ``split`` is the start of their byte range.

    Files and places go by the hash of their names, as numbers are cheap to group and join.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    name, split = "_metadata.file_path", "_metadata.file_block_start"
    return text.select(
        F.xxhash64(name).alias("file"),
        F.col(split).alias("split"),
        F.xxhash64(name, split).alias("place"),
        F.col("value").alias("line"),
    )


def quote_parity(found: DataFrame) -> DataFrame | None:
    """``(file, split, place, range, begin, inside, after)``: whether a range begins a file,
    and whether it begins and ends inside quotes; ``range`` numbers them.

    None if every line closes the quotes that it opens, so that lines are records.
    """
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))
    counted = settled(
        found.groupBy("file", "split", "place").agg(
            F.sum(quotes).alias("quotes"), F.count_if(quotes % 2 == 1).alias("open")
        )
    ).table
    if not counted.agg(F.sum("open")).first()[0]:
        return None
    until = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("quotes").over(until)
    state = settled(
        counted.select(
            "file",
            "split",
            "place",
            F.monotonically_increasing_id().alias("range"),
            (F.col("split") == 0).alias("begin"),
            ((total - F.col("quotes")) % 2 == 1).alias("inside"),
            (total % 2 == 1).alias("after"),
        )
    ).table
    ends = state.groupBy("file").agg(F.max_by("after", "split").alias("open")).where("open")
    if not ends.isEmpty():
        raise ValueError("a quote is not closed")
    return state


def cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order, to whole records, or to the pieces at the ends of ranges."""
    key, inside, shared, first = None, False, False, False
    held: list[pa.Array] = []

    def piece(kind: int, texts: pa.Array, lead: bool) -> pa.RecordBatch:
        n = len(texts)
        flags = np.zeros(n, bool)
        flags[:1] = lead
        columns = {"first": pa.array(flags), "text": texts.cast(pa.string())}
        if not whole:
            place = {"range": pa.repeat(key, n), "kind": pa.repeat(pa.scalar(kind, pa.int32()), n)}
            columns = place | columns
        return pa.RecordBatch.from_pydict(columns)

    def joined(arrays: list[pa.Array]) -> pa.Array:
        every = pa.concat_arrays([a.cast(pa.string()) for a in arrays])
        return pc.binary_join(pa.ListArray.from_arrays([0, len(every)], every), "\n")

    def rest() -> Iterator[pa.RecordBatch]:
        if held and not whole:
            yield piece(MIDDLE if shared else BEGIN, joined(held), first)

    for batch in batches:
        ranges = batch.column("range").to_numpy()
        quotes = pc.count_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False)
        turns = (np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist()
        for a, b in zip([0, *turns], [*turns, len(ranges)], strict=True):
            if a == b:
                continue
            if int(ranges[a]) != key:
                yield from rest()
                key, held, first = int(ranges[a]), [], batch.column("begin")[a].as_py()
                inside = shared = batch.column("inside")[a].as_py()
            own = batch.column("line").slice(a, b - a)
            after = (np.cumsum(quotes[a:b]) + inside) % 2 == 1
            inside = bool(after[-1])
            ends = np.flatnonzero(~after) + 1
            if not len(ends):
                held.append(own)
                continue
            begin = 0
            if held or shared:
                if shared != whole:
                    kind = END if shared else WHOLE
                    yield piece(kind, joined([*held, own.slice(0, ends[0])]), first)
                first, shared, begin = False, False, 1
            if whole and len(ends) > begin:
                offsets = pa.array(np.append(0, ends)[begin:], pa.int32())
                texts = own.cast(pa.string())
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "\n")
                yield piece(WHOLE, records, first)
            first = first and len(ends) <= begin
            held = [own.slice(ends[-1])] if ends[-1] < len(own) else []
    yield from rest()


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """``(first, text)``: the records of CSV files; ``first`` marks the first of a file.

    None if no record goes over a line break, so that Spark's own reader parts them right.
    """
    found = lines(spark, path)
    try:
        state = quote_parity(found)
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from None
    if state is None:
        return None
    # One row for each byte range; a range that the count did not meet fails the read, as
    # it would if the file or the size of ranges changed in between.
    given = found.select("place", "line")
    facts = state.select("place", "range", "begin", "inside", "after")
    begun = given.join(F.broadcast(facts.drop("after")), "place", "left")
    unknown = F.raise_error(F.lit(f"{path}: changed while it was read"))
    known = begun.withColumn("range", F.coalesce("range", unknown.cast("long")))
    bordering = given.join(F.broadcast(facts.where("inside or after").drop("after")), "place")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, True)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, False)

    # A record that ranges share begins with a BEGIN; what follows it in the file is its rest.
    place = F.struct("split", F.when(F.col("kind") == BEGIN, 1).otherwise(0).alias("late"))
    cuts = settled(bordering.select(*LINES).mapInArrow(ends, PIECES)).table
    pieces = cuts.join(state.select("range", "file", "split"), "range")
    upto = Window.partitionBy("file").orderBy(place)
    shared = (
        pieces.withColumn("record", F.count_if(F.col("kind") == BEGIN).over(upto))
        .groupBy("file", "record")
        .agg(
            F.max("first").alias("first"),
            F.sort_array(F.collect_list(F.struct(place.alias("place"), "text"))).alias("parts"),
        )
        .select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )
    own = known.select(*LINES).mapInArrow(whole, RECORDS)
    return own.unionByName(shared)
