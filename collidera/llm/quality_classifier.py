"""Document quality: logistic regression on hashed word n-grams.

Weights are learned with follow-the-regularised-leader updates, which leave most of
them at exactly zero, and a text is scored as one sparse dot product.

Defined results: a null text scores as an empty one; an empty text has no terms and
scores by the bias alone; without any label of both kinds every text scores the share
of good labels (0.5 where there is none). Rows are scored one by one, so repeated rows,
ties and null ids change nothing, and columns besides ``doc_id``, ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collidera.llm.terms import (
    Scorer,
    TermHashes,
    folded,
    hash_part,
    labelled_sample,
    neighbour_pairs,
    sample_features,
    sigmoid,
    trained,
    with_score,
)

BITS = 18


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the updates; ``rows`` bounds the labelled sample."""

    rows: int = 6000
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    seed: int = 6


def word_ngrams(text: str, hashes: TermHashes) -> tuple[np.ndarray, np.ndarray]:
    """Columns of words and word pairs, with damped and length-normalised counts."""
    words = hashes.of(text)
    grams = np.concatenate([words, neighbour_pairs(words)]) if len(words) else words
    columns, counts = np.unique(folded(grams, BITS), return_counts=True)
    values = 1 + np.log(counts)
    return columns, values * (4 / np.sqrt(max(1.0, float(values @ values))))


def ftrl(examples: list, p: Ftrl) -> np.ndarray:
    """Weights by column, the bias last."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == 2**BITS, 0, p.l1), 0)
        return -shrunk / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for label, columns, values in examples:
            at, x = np.append(columns, 2**BITS), np.append(values, 1.0)
            w = weights(at)
            g = (sigmoid(float(w @ x)) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    return weights(np.arange(2**BITS + 1))


def fit_quality(
    documents: DataFrame, labels: DataFrame, admitted: Column, p: Ftrl = Ftrl()
) -> np.ndarray:
    """Weights learned from the labels that ``admitted``, a condition on them, allows."""

    def train(examples: list) -> bytes:
        good = sum(label for label, *_ in examples)
        if 0 < good < len(examples):
            return ftrl(examples, p).tobytes()
        share = (good + 0.5) / (len(examples) + 1)
        return np.append(np.zeros(2**BITS), np.log(share / (1 - share))).tobytes()

    sample = labelled_sample(documents, labels, "quality", admitted, p.rows, p.seed)
    return np.frombuffer(trained(sample_features(sample, word_ngrams), p.rows, train))


def quality_scorer(spark: SparkSession, weights: np.ndarray) -> Scorer:
    """The probability that a text is good, for ``with_score`` and ``kept_by_score``."""
    shared = spark.sparkContext.broadcast(weights)

    def scorer() -> Callable[[str], float]:
        w, hashes = shared.value, TermHashes()

        def of(text: str) -> float:
            columns, values = word_ngrams(text, hashes)
            return sigmoid(float(w[columns] @ values) + float(w[-1]))

        return of

    return scorer


def quality(documents: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; thirds of the ids are held out of learning."""
    held_out = F.coalesce(hash_part("doc_id", 3) == 1, F.lit(False))
    weights = fit_quality(documents, labels, ~held_out, p)
    scorer = quality_scorer(documents.sparkSession, weights)
    scored = with_score(documents.select("doc_id", "text"), scorer)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
