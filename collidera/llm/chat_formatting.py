"""Preference pairs: one prompt, two completions, masked.

For a chosen and a rejected conversation the longest common prefix of turns is rendered
once as the prompt; the turns after it are the two completions. In a completion only
what an assistant says, with its end mark, is learned; the spans of it are given as
character offsets, and everything else is masked. Built-in expressions only.

Defined results: turns are ordered by number, then role and text, and repeated rows are
turns of their own. A null role renders as an empty one, a null text as no text; nulls
equal nulls in the prefix. Without a rejected conversation the prompt ends before the
last assistant turn and ``rejected`` is null. If one conversation continues the other,
or both are equal, the shorter completion is an empty text. A row without ``conv_id`` is a
conversation of its own, with a null id. Columns besides the four named ones are ignored; an empty table gives
an empty one. A conversation has to fit one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.sources.shared_folder import settled


@dataclass(frozen=True)
class Template:
    """How a turn is written, and whose turns are learned."""

    before_role: str = "<|"
    after_role: str = "|>\n"
    end: str = "<|end|>\n"
    learned_role: str = "assistant"


#: A conversation: its id, or the number of a row that has none.
KEY = ["conv_id", "_row"]


def numbered(turns: DataFrame) -> DataFrame:
    """The four columns and ``_row``, a number for each row without an id."""
    columns = turns.select("conv_id", "turn", "role", "text")
    number = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    return settled(columns.withColumn("_row", number)).table


def conversations_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, _row, turns)``: each conversation's ordered ``(role, text)``."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = F.transform(
        ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    return turns.groupBy(*KEY).agg(rows.alias("turns"))


def paired_by_opening(turns: DataFrame, group_rows: int = 1000) -> DataFrame:
    """``(chosen_id, rejected_id, chosen_row, rejected_row)``: neighbours by opening turn.

    Every conversation is in one pair, and at most one of each opening is left alone,
    with a null ``rejected_id``. The smaller id is the chosen one. Conversations are
    first paired within seeded parts of an opening, then the odd ones of all parts, so no
    task sees more than a part of a very common opening.
    """
    first = turns.groupBy(*KEY).agg(
        F.min(F.struct("turn", "role", "text")).alias("_first")
    )
    parts_of_turn = [F.coalesce(f"_first.{c}", F.lit("\x00")) for c in ("role", "text")]
    opening = F.sha2(F.concat_ws("\x1f", *parts_of_turn), 256)
    known = settled(first.select(*KEY, opening.alias("opening")))
    parts = max(1, -(-known.rows // group_rows))
    dealt = known.table.withColumn("part", F.pmod(F.coalesce(*KEY), F.lit(parts)))

    def neighbours(df: DataFrame, *by: str) -> DataFrame:
        own = Window.partitionBy(*by).orderBy(*KEY)
        return df.withColumns(
            {
                "_rn": F.row_number().over(own),
                "_next": F.lead("conv_id").over(own),
                "_next_row": F.lead("_row").over(own),
                "_any": F.lead(F.lit(1)).over(own),
            }
        ).filter("_rn % 2 = 1")

    once = settled(neighbours(dealt, "opening", "part")).table
    odd = neighbours(once.filter("_any is null").select(*KEY, "opening"), "opening")
    names = {"conv_id": "chosen_id", "_next": "rejected_id", "_row": "chosen_row", "_next_row": "rejected_row"}
    columns = [F.col(c).alias(name) for c, name in names.items()]
    return once.filter("_any is not null").select(*columns).unionByName(odd.select(*columns))


def rendered(turns: Column, t: Template) -> Column:
    """Turns as text."""
    return F.array_join(F.transform(turns, lambda x: rendered_turn(x, t)), "")


def rendered_turn(turn: Column, t: Template) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(t.before_role), role, F.lit(t.after_role), text, F.lit(t.end))


def learned_spans(turns: Column, t: Template) -> Column:
    """``(start, end)`` characters of a rendered completion that are learned."""
    sizes = F.transform(turns, lambda x: F.length(rendered_turn(x, t)))
    ends = F.transform(
        sizes, lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b)
    )
    spans = F.zip_with(
        turns,
        ends,
        lambda x, e: F.struct(
            (e - F.length(F.coalesce(x["text"], F.lit(""))) - len(t.end)).alias("start"),
            e.alias("end"),
            F.coalesce(x["role"] == t.learned_role, F.lit(False)).alias("learned"),
        ),
    )
    return F.transform(
        F.filter(spans, lambda s: s["learned"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns two conversations share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(F.size(a))


def prompt_of_one(turns: Column, t: Template) -> Column:
    """Turns before the last learned one; all of them where there is none."""
    places = F.transform(turns, lambda x, i: F.when(x["role"] == t.learned_role, i))
    return F.coalesce(F.array_max(places), F.size(turns))


def preference_pairs(turns: DataFrame, pairs: DataFrame, t: Template = Template()) -> DataFrame:
    """``(chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_learned,
    rejected_learned)``, one row per pair of ``paired_by_opening``; ``turns`` are numbered."""
    whole = settled(conversations_of(turns)).table
    chosen = whole.select(F.col("conv_id").alias("_c"), F.col("_row").alias("_cr"), F.col("turns").alias("a"))
    rejected = whole.select(F.col("conv_id").alias("_r"), F.col("_row").alias("_rr"), F.col("turns").alias("b"))

    def same(number: str, row: str, conv: str, own: str) -> Column:
        return F.col(number).eqNullSafe(F.col(conv)) & F.col(row).eqNullSafe(F.col(own))

    found = pairs.join(chosen, same("chosen_id", "chosen_row", "_c", "_cr")).join(
        rejected, same("rejected_id", "rejected_row", "_r", "_rr"), "left"
    )
    shared = F.when(F.col("b").isNull(), prompt_of_one(F.col("a"), t)).otherwise(
        common_prefix(F.col("a"), F.col("b"))
    )

    def rest(c: Column) -> Column:
        return F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(0)))

    cut = found.withColumn("prompt_turns", shared).select(
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        F.slice("a", F.lit(1), F.col("prompt_turns")).alias("p"),
        rest(F.col("a")).alias("a"),
        rest(F.col("b")).alias("b"),
    )
    return cut.select(
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        rendered(F.col("p"), t).alias("prompt"),
        rendered(F.col("a"), t).alias("chosen"),
        rendered(F.col("b"), t).alias("rejected"),
        learned_spans(F.col("a"), t).alias("chosen_learned"),
        learned_spans(F.col("b"), t).alias("rejected_learned"),
    )


def preferences(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """All conversations of a table as preference pairs, paired by their opening turn."""
    known = numbered(turns)
    return preference_pairs(known, paired_by_opening(known), t)
