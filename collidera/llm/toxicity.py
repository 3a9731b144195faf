"""Document toxicity: a factorisation machine over hashed terms.

``logit = bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``: besides a weight, each
term has a short vector, and the product of two vectors is what the pair of terms adds.
The pair sum costs one pass over the terms of a text.

Defined results: a null text scores as an empty one, by the bias alone; without labels
of both kinds every text scores the share of toxic labels (0.5 where there is none).
Rows are scored one by one, so repeated rows, ties and null ids change nothing, and
columns besides ``doc_id``, ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collidera.llm.terms import (
    MEMO_TERMS,
    TERM,
    Scorer,
    TermHashes,
    folded,
    hash_part,
    labelled_sample,
    sample_features,
    sigmoid,
    trained,
    with_score,
)

BITS = 18
STEMS = (4, 6)


@dataclass(frozen=True)
class Machine:
    """Parameters of learning; ``rows`` bounds the labelled sample.

    A vector entry leaves its start once its gradients add up to more than
    ``factor_chance`` times the root of their squares.
    """

    rows: int = 10_000
    factors: int = 4
    epochs: int = 4
    alpha: float = 0.4
    l1: float = 6.0
    factor_rate: float = 0.1
    factor_decay: float = 1e-3
    factor_chance: float = 3.0
    seed: int = 1


class Stems(dict):
    """Hashes of words cut to a length, so that inflected forms share a term."""

    def __init__(self, length: int):
        self.length = length

    def __missing__(self, word: str) -> int:
        cut = f"{word[: self.length]}*".encode("utf-8", "surrogatepass")
        self[word] = value = xxhash.xxh32_intdigest(cut)
        return value


class Presence:
    """Columns of the terms and stems of a text; each counts once."""

    def __init__(self):
        self.words = TermHashes()
        self.stems = [Stems(n) for n in STEMS]

    def __call__(self, text: str, _: TermHashes | None = None) -> tuple[np.ndarray, np.ndarray]:
        words = set(TERM.findall(text.lower()))
        found = []
        for memo in (self.words, *self.stems):
            if len(memo) > MEMO_TERMS:
                memo.clear()
            known = words if memo is self.words else [w for w in words if len(w) > memo.length]
            found.append(np.fromiter(map(memo.__getitem__, known), np.uint64, len(known)))
        columns = np.unique(folded(np.concatenate(found), BITS))
        return columns, np.ones(len(columns), np.float32)


def logit(bias: float, w: np.ndarray, v: np.ndarray) -> float:
    """Score of the terms whose weights and vectors are given."""
    total = v.sum(axis=0)
    return bias + float(w.sum()) + 0.5 * float(total @ total - (v * v).sum())


def fit_machine(examples: list, p: Machine) -> np.ndarray:
    """Rows of ``(weight, vector)`` by column; the last row's weight is the bias.

    Weights take leader updates with a penalty that keeps chance terms at zero; vectors
    take adaptive averaged steps with a penalty that keeps chance terms at their start,
    and only of terms that two examples share.
    """
    size = 2**BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    start = np.random.default_rng(p.seed).normal(0, 0.01, (size, p.factors))
    seen = np.zeros(size, np.int32)
    for _, columns, _ in examples:
        seen[columns] += 1
    start[seen < 2] = 0
    v, moved = start.copy(), np.zeros((size, p.factors))
    squares = np.full((size, p.factors), 1e-4)
    toxic = sum(label for label, *_ in examples)
    bias, bias_squares = np.log(toxic / (len(examples) - toxic)), 1.0
    for _ in range(p.epochs):
        for label, columns, _ in examples:
            at = columns[seen[columns] > 1]
            if not len(at):
                continue
            vi = v[at]
            g = sigmoid(logit(bias, w[at], vi)) - label
            bias_squares += g * g
            bias -= 0.05 * g / np.sqrt(bias_squares)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w[at]
            n[at] += g * g
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - p.l1, 0)
            w[at] = -shrunk * p.alpha / (1 + np.sqrt(n[at]))
            gv = g * (vi.sum(axis=0) - vi) + p.factor_decay * (vi - start[at])
            total, scale = moved[at] + gv, squares[at] + gv * gv
            moved[at], squares[at] = total, scale
            sure = np.maximum(np.abs(total) / np.sqrt(scale) - p.factor_chance, 0)
            v[at] = start[at] - p.factor_rate * np.sign(total) * sure
    model = np.hstack([w[:, None], v])
    model[seen < 2] = 0
    return np.vstack([model, np.append(bias, np.zeros(p.factors))]).astype(np.float32)


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, admitted: Column, p: Machine = Machine()
) -> np.ndarray:
    """The machine learned from the labels that ``admitted``, a condition on them, allows."""

    def train(examples: list) -> bytes:
        toxic = sum(label for label, *_ in examples)
        if 0 < toxic < len(examples):
            return fit_machine(examples, p).tobytes()
        share = (toxic + 0.5) / (len(examples) + 1)
        model = np.zeros((2**BITS + 1, p.factors + 1), np.float32)
        model[-1, 0] = np.log(share / (1 - share))
        return model.tobytes()

    sample = labelled_sample(documents, labels, "toxic", admitted, p.rows, p.seed)
    model = np.frombuffer(
        trained(sample_features(sample, Presence()), p.rows, train), np.float32
    )
    return model.reshape(2**BITS + 1, -1)


def toxicity_scorer(spark: SparkSession, machine: np.ndarray) -> Scorer:
    """The probability that a text is toxic, for ``with_score`` and ``kept_by_score``."""
    shared = spark.sparkContext.broadcast(machine)

    def scorer() -> Callable[[str], float]:
        model, presence = shared.value, Presence()

        def of(text: str) -> float:
            columns, _ = presence(text)
            rows = model[columns].astype(np.float64)
            return sigmoid(logit(float(model[-1, 0]), rows[:, 0], rows[:, 1:]))

        return of

    return scorer


def toxicity(documents: DataFrame, labels: DataFrame, p: Machine = Machine()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; a quarter of the ids is held out of learning."""
    held_out = F.coalesce(hash_part("doc_id", 4) == 2, F.lit(False))
    machine = fit_toxicity(documents, labels, ~held_out, p)
    scorer = toxicity_scorer(documents.sparkSession, machine)
    scored = with_score(documents.select("doc_id", "text"), scorer)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.3).cast("int").alias("predicted"),
    )
