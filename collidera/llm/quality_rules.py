"""Document quality by lines: clean first, then reject what lost too much.

Every line is judged by itself. A line with words is removed when it

* has at most ``unended_words`` words and ends without a final punctuation mark
  (``no_end``); longer lines without one are prose that was cut and stay,
* is navigation (``navigation``: separators such as ``|`` or ``»`` make up a fifth or
  more of its words, two of them at least),
* is boilerplate (``boilerplate``: it contains one of the fixed phrases),
* is mostly symbols (``symbols``: a tenth or more of its words hold one of ``#*$%&|<>``
  doubled, or ``!!``).

A document is kept when the lines that remain hold at least ``min_kept_share`` of its
words, it has 50 words, and at most half of its words stand in repeated three-word
windows.

Defined results: a null, empty or blank text has no words, all counts are zero and the
base rules reject it. Repeated rows give repeated results, a null id stays null, and
columns besides ``doc_id`` and ``text`` are ignored. Everything is computed on whole
texts, line by line, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_SPACE = " \t\n\v\f\r"
BLANKS = " \t\v\f\r"
SYMBOLS = "#*$%&|<>"
SYMBOL_RUN = re.compile(r"([#*$%&|<>])\1|!!")
ENDS = tuple(".!?:;\"'…»”)")
SEPARATORS = {"|", "»", "›", ">", "/", "·", "•", "::"}

#: Fixed phrases of page furniture.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "read more",
    "subscribe to",
    "sign up",
    "log in",
    "lorem ipsum",
    "enable javascript",
)

BOILERPLATE_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)))
SUSPECT = re.compile(f"{SYMBOL_RUN.pattern}|[{''.join(sorted({x[0] for x in SEPARATORS}))}]")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules: shares of words, and the longest line that needs an end."""

    unended_words: int = 20
    min_kept_share: float = 0.7
    navigation_share: float = 0.2
    symbol_share: float = 0.1


def repeated_window_words(words: list) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4 or len(set(zip(words, words[1:], words[2:], strict=False))) == n - 2:
        return 0
    ids: dict = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * len(ids) + at[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def line_verdict(line: str, rules: LineRules) -> tuple[str | None, int]:
    """The rule that removes a line, or None, and how many words the line has."""
    words = WORD.findall(line)
    if not words:
        return None, 0
    n = len(words)
    separators = sum(w in SEPARATORS for w in words)
    if separators >= 2 and separators >= rules.navigation_share * n:
        return "navigation", n
    if BOILERPLATE_PHRASE.search(line.lower()):
        return "boilerplate", n
    noisy = sum(SYMBOL_RUN.search(w) is not None for w in words)
    if noisy and noisy >= rules.symbol_share * n:
        return "symbols", n
    if n <= rules.unended_words and not words[-1].endswith(ENDS):
        return "no_end", n
    return None, n


def judged(text: str | None, rules: LineRules = LineRules()) -> dict:
    """Counts, verdict and cleaned text of one document."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    # Only where a text holds a trigger anywhere can a line of it break a rule on words.
    watched = SUSPECT.search(text) is not None or BOILERPLATE_PHRASE.search(text.lower())
    seen: set[str] = set()
    kept_lines: list[str] = []
    dup_lines = removed = lost_words = 0
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        if bare:
            dup_lines += line in seen
            seen.add(line)
        if watched or (bare and not bare.endswith(ENDS)):
            rule, line_words = line_verdict(line, rules)
            if rule:
                removed += 1
                lost_words += line_words
                continue
        kept_lines.append(line)
    repeats = repeated_window_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    kept_words = n - lost_words
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "n_removed_lines": removed,
        "n_kept_words": kept_words,
        "kept": not base_failed and kept_words >= rules.min_kept_share * n,
        "clean_text": "\n".join(kept_lines),
    }


COLUMNS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "n_removed_lines": pa.int64(),
    "n_kept_words": pa.int64(),
    "kept": pa.bool_(),
    "clean_text": pa.string(),
}
SQL_NAMES = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string"}


def quality_rules(
    documents: DataFrame, rules: LineRules = LineRules(), with_text: bool = True
) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept`` and, if asked for, ``clean_text``."""
    columns = {k: v for k, v in COLUMNS.items() if with_text or k != "clean_text"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(t, rules) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([r[k] for r in rows], kind) for k, kind in columns.items()),
                ],
                names=["doc_id", *columns],
            )

    schema = ", ".join(f"{k} {SQL_NAMES[v]}" for k, v in columns.items())
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {schema}")
