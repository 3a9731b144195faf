"""Language of a text: unigram pieces, summed over all segmentations.

The pieces come from a public vocabulary that is only read. Each language has a
probability for every piece, and the likelihood of a word is the sum over all ways to
cut it into pieces, computed by a forward pass; no single segmentation is chosen. The
probabilities are learned by expectation maximisation over the same sums. Words are runs
of letters in lower case with a word-start mark, of any length; sums over long ones are
kept as logarithms. Letters outside the vocabulary have one small probability in every
language.

Learning reads a sample of at most ``rows`` different texts per language; every text is
scored whole.

Defined results: a null text and a text without letters are ``und`` with score 0; so is
everything when no language could be learned; a language whose sample has no letter is
not. Equal likelihoods go to the first language
by code point. Repeated rows give repeated results, null ids stay, and columns besides
the four named ones are ignored. Nothing is shuffled but the sample. More languages than
``model_bytes`` can hold fail the query; none is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collidera.llm.terms import hash_part

LETTERS = re.compile(r"[^\W\d_]+")
#: Letters up to which no product of probabilities leaves the range of doubles.
PLAIN_PRODUCTS = 40
START = "▁"
UNKNOWN = 1e-7
UNDETERMINED = "und"


@dataclass(frozen=True)
class Learning:
    """``rows`` different texts are drawn per language, and ``model_bytes`` bound the model.

    A worker remembers words up to ``memory_bytes``.
    """

    rows: int = 800
    model_bytes: int = 256 << 20
    memory_bytes: int = 64 << 20
    rounds: int = 4
    smoothing: float = 0.1
    vocabulary: str | None = None
    seed: int = 3


class Pieces:
    """The vocabulary's pieces made of letters, by text.

    ``path`` names a SentencePiece model on the machine that reads it; by default the
    32,000 pieces that the environment offers.
    """

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            bare = piece.removeprefix(START)
            if piece == START or LETTERS.fullmatch(bare) and bare == bare.lower():
                self.ids.setdefault(piece, len(self.ids))
        self.longest = max(map(len, self.ids))
        self.unknown = len(self.ids)

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece ids of the spans of equally long words: ``[start, letters - 1, word]``, -1 where none.

        No piece is longer than ``longest``, so the lattice grows with the length of the words.
        """
        size = len(words[0])
        spans = np.full((size, min(size, self.longest), len(words)), -1, np.int32)
        get = self.ids.get
        for i in range(size):
            for k in range(min(size - i, self.longest)):
                spans[i, k] = [get(w[i : i + k + 1], -1) for w in words]
            single = spans[i, 0]
            single[single < 0] = self.unknown
        return spans


def words_of(text: str) -> list[str]:
    """Marked lower-case words."""
    return [START + w for w in LETTERS.findall(text.lower())]


def forward(spans: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of each prefix: ``(size + 1, words, languages)``.

    ``probs`` has a row per piece, the unknown letter's and a row of zeros last.
    """
    size, longest, n = spans.shape
    alpha = np.zeros((size + 1, n, probs.shape[1]))
    alpha[0] = 1
    for j in range(1, size + 1):
        for k in range(min(j, longest)):
            ids = spans[j - k - 1, k]
            if (ids >= 0).any():
                alpha[j] += alpha[j - k - 1] * probs[ids]
    return alpha


def forward_logs(spans: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of what ``forward`` sums, for words of any length."""
    size, longest, n = spans.shape
    alpha = np.full((size + 1, n, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for j in range(1, size + 1):
        k = np.arange(min(j, longest))
        ways = alpha[j - 1 - k] + logs[spans[j - 1 - k, k]]
        top = ways.max(axis=0)
        alpha[j] = top + np.log(np.exp(ways - top).sum(axis=0))
    return alpha


def word_logs(spans: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Log likelihoods of equally long words by language."""
    if len(spans) <= PLAIN_PRODUCTS:
        return np.log(np.maximum(forward(spans, probs)[-1], 1e-300))
    with np.errstate(divide="ignore"):
        return forward_logs(spans, np.log(probs))[-1]


def expected_counts(spans: np.ndarray, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of every piece over all segmentations, for one language."""
    if len(spans) > PLAIN_PRODUCTS:
        return _expected_by_logs(spans, probs, weights)
    size, longest, n = spans.shape
    alpha = forward(spans, probs)[:, :, 0]
    beta = np.zeros((size + 1, n))
    beta[size] = 1
    counts = np.zeros(len(probs))
    per_word = weights / np.maximum(alpha[size], 1e-300)
    for i in range(size - 1, -1, -1):
        for k in range(min(size - i, longest)):
            ids = spans[i, k]
            hit = ids >= 0
            if hit.any():
                step = np.where(hit, probs[ids, 0], 0) * beta[i + k + 1]
                beta[i] += step
                np.add.at(counts, ids[hit], (alpha[i] * step * per_word)[hit])
    return counts


def _expected_by_logs(spans: np.ndarray, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    size, longest, n = spans.shape
    with np.errstate(divide="ignore"):
        logs = np.log(probs)
    alpha = forward_logs(spans, logs)[:, :, 0]
    beta = np.full((size + 1, n), -np.inf)
    beta[size] = 0
    counts = np.zeros(len(probs))
    for i in range(size - 1, -1, -1):
        for k in range(min(size - i, longest)):
            ids = spans[i, k]
            hit = ids >= 0
            if hit.any():
                step = np.where(hit, logs[ids, 0], -np.inf) + beta[i + k + 1]
                beta[i] = np.logaddexp(beta[i], step)
                share = np.exp(alpha[i] + step - alpha[size]) * weights
                np.add.at(counts, ids[hit], share[hit])
    return counts


def learned(texts: list[str], pieces: Pieces, p: Learning) -> np.ndarray:
    """Piece probabilities of one language, by expectation maximisation."""
    by_size: dict[int, Counter] = {}
    for text in texts:
        for word in words_of(text):
            by_size.setdefault(len(word), Counter())[word] += 1
    lattices = [
        (pieces.lattice(list(c)), np.array(list(c.values()), float)) for c in by_size.values()
    ]
    size = pieces.unknown
    probs = np.full(size, 1 / max(size, 1))
    for _ in range(p.rounds):
        counts = np.full(size, p.smoothing)
        for spans, weights in lattices:
            full = np.concatenate([probs, [UNKNOWN, 0]])[:, None]
            counts += expected_counts(spans, full, weights)[:size]
        probs = counts / counts.sum()
    return probs


def language_sample(known: DataFrame, rows: dict[str, int], p: Learning) -> DataFrame:
    """``(lang, text)``: at most ``p.rows`` different texts of each language.

    ``rows`` says how many each has. A hash of the text draws a fifth more than asked for,
    all copies of a text or none; they become one before they meet, and the first by hash stay.
    """
    share = F.create_map(*[F.lit(x) for k, n in rows.items() for x in (k, 1.2 * p.rows / n)])
    draw = F.xxhash64(F.lit(p.seed), "text")
    spot = F.pmod(draw, F.lit(2**40)) / 2.0**40
    drawn = known.filter(spot < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy(draw, "text")
    ranked = drawn.select("lang", "text").distinct().withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= p.rows).drop("place")


def fit_languages(
    documents: DataFrame, admitted: Column, p: Learning = Learning()
) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their piece probabilities, a column each."""
    known = documents.filter(admitted & F.col("lang").isNotNull()).select("lang", "text")
    pieces = Pieces(p.vocabulary)
    most = max(1, p.model_bytes // (8 * max(1, pieces.unknown)))
    counts = known.groupBy("lang").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages; raise model_bytes")
    if not counts:
        return [], np.zeros((0, 0))
    sample = language_sample(known, {r["lang"]: r["count"] for r in counts}, p)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in group["text"] if t is not None)
        if not any(map(LETTERS.search, texts)):
            return pd.DataFrame({"lang": [], "probs": []}, dtype=object)
        probs = learned(texts, Pieces(p.vocabulary), p)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "probs": [probs.tobytes()]})

    by_language = sample.select("lang", "text").groupBy("lang")
    rows = by_language.applyInPandas(learn, "lang string, probs binary").collect()
    if not rows:
        return [], np.zeros((0, 0))
    found = sorted(rows, key=lambda r: r["lang"])
    columns = [np.frombuffer(r["probs"]) for r in found]
    return [r["lang"] for r in found], np.stack(columns, axis=1)


class WordScores:
    """Log likelihoods of words by language, kept for words seen before."""

    def __init__(self, pieces: Pieces, probs: np.ndarray, memory_bytes: int):
        self.kept = max(1, memory_bytes // (8 * probs.shape[1]))
        tail = np.zeros((2, probs.shape[1]))
        tail[0] = UNKNOWN
        self.pieces, self.probs = pieces, np.vstack([probs, tail])
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, probs.shape[1]))

    def learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        for same in by_size.values():
            # Long words in small parts, so that a lattice stays small.
            step = max(1, 2048 * 24 // max(24, len(same[0])))
            for k in range(0, len(same), step):
                part = same[k : k + step]
                logs = word_logs(self.pieces.lattice(part), self.probs)
                first = len(self.rows)
                while len(self.logs) < first + len(part):
                    self.logs = np.vstack([self.logs, np.zeros_like(self.logs)])
                self.logs[first : first + len(part)] = logs
                self.rows.update(zip(part, range(first, first + len(part)), strict=True))

    def of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log likelihoods of whole texts, None where there is no letter."""
        result = []
        for k in range(0, len(texts), 256):
            if len(self.rows) > self.kept:
                self.rows.clear()
            found = [words_of(t) if t else [] for t in texts[k : k + 256]]
            self.learn(sorted({w for words in found for w in words} - self.rows.keys()))
            at = self.rows.__getitem__
            for words in found:
                rows = np.fromiter(map(at, words), np.int64, len(words))
                result.append(self.logs[rows].sum(axis=0) if words else None)
        return result


def language_scores(
    documents: DataFrame, languages: list[str], probs: np.ndarray, p: Learning = Learning()
) -> DataFrame:
    """``(doc_id, lang_pred, score)``; the score is the posterior at equal priors."""
    shared = documents.sparkSession.sparkContext.broadcast(probs)

    def verdict(logs: np.ndarray | None) -> tuple[str, float]:
        if logs is None or not languages:
            return UNDETERMINED, 0.0
        best = int(np.argmax(logs))
        return languages[best], float(1 / np.exp(logs - logs[best]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(Pieces(p.vocabulary), shared.value, p.memory_bytes) if languages else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = scores.of(texts) if scores else [None] * len(texts)
            found = [verdict(s) for s in sums]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([v for v, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, lang_pred string, score double"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def language_id(documents: DataFrame, p: Learning = Learning()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; a fifth of the ids is held out of learning."""
    held_out = F.coalesce(hash_part("doc_id", 5) == 0, F.lit(False))
    languages, probs = fit_languages(documents, ~held_out, p)
    scored = language_scores(documents, languages, probs, p)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
