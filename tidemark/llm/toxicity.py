"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, neighbouring word
pairs and pairs with one word between.  They count as present or absent, so
one insult in a long text weighs as much as in a short one.  Training follows
each example with per-coordinate rates; L1 keeps most weights at exactly zero,
and what is left is a short table of (hash, weight) that every task can hold.

The model is fitted on a bounded sample (``SAMPLE`` documents) in one group.
Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, learning_sample

SAMPLE = 12_000  # labelled documents used for fitting at most
MIN_DOCS = 3  # features of fewer sample documents are not learnt
EPOCHS = 8
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.5
THRESHOLD = 0.3
KEPT_BYTES = 32 << 20  # of words per Python worker, by estimate
LONGEST_KEPT = 256  # longer words are hashed each time
FILTER_BITS = 16
COUNT_BITS = 27  # counters that tell rare features of the sample apart

_WORD = re.compile(r"[^\W\d_]+")
# Odd multipliers that keep the kinds of features apart.
_PAIR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SKIP = (np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


class WordHashes(dict):
    """Word -> 64-bit hash, for the words seen last."""

    held = 0

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode(errors="replace"), digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            self.held += 180 + 4 * len(word)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 180 + 4 * len(word)
            self[word] = value
        return value


def feature_hashes(text: str, known: WordHashes) -> np.ndarray:
    """Hashes of words, pairs and skip pairs, in text order, possibly repeated."""
    words = _WORD.findall(text.lower())
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return np.concatenate((h, h[:-1] * _PAIR[0] + h[1:] * _PAIR[1], h[:-2] * _SKIP[0] + h[2:] * _SKIP[1]))


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, size: int, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of ``size`` coordinates and the bias (a coordinate without L1)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z[at]) - l1[at], 0.0)
        return -np.sign(z[at]) * pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        found = [np.unique(feature_hashes(t, known)).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "features"])


def _places(names: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in the sorted ``names`` of those of ``found`` that are there."""
    if not len(names):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, found), len(names) - 1)
    return at[names[at] == found]


def _without_rare(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Drop features that fewer than MIN_DOCS rows have, but for a few that share a counter."""
    slots = [r & ((1 << COUNT_BITS) - 1) for r in rows]
    counts = np.zeros(1 << COUNT_BITS, np.uint8)
    for s in slots:
        counts[s] = np.minimum(counts[s], MIN_DOCS) + 1
    return [r[counts[s] >= MIN_DOCS] for r, s in zip(rows, slots, strict=True)]


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values("doc_id", kind="stable")
    rows = _without_rare([np.asarray(f, np.int64) for f in sample["features"]])
    names, counts = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]), return_counts=True)
    names = names[counts >= MIN_DOCS]
    rows = [_places(names, r) for r in rows]
    w, bias = fit_ftrl(rows, sample["y"].to_numpy(float), len(names), EPOCHS)
    used = np.flatnonzero(w)
    table = pd.DataFrame({"feature": names[used], "weight": w[used], "is_bias": False})
    return pd.concat([table, pd.DataFrame({"feature": np.zeros(1, np.int64), "weight": [bias], "is_bias": [True]})])


@dataclass
class Model:
    """Sorted feature hashes, their weights and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        # Most features have no weight; low bits of the hash tell so at once.
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.features & np.uint64((1 << FILTER_BITS) - 1)] = True

    def score(self, text: str, known: WordHashes) -> float:
        h = feature_hashes(text, known)
        h = np.unique(h[self.filter[h & np.uint64((1 << FILTER_BITS) - 1)]])
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.weights[_places(self.features, h)].sum(), -35, 35))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = SAMPLE) -> Model:
    """Fit on the learning sample.  Without any labelled document every score is 0.5."""
    sample = learning_sample(docs, labels, label_col, limit).mapInArrow(_sample_features, "doc_id bigint, y int, features array<bigint>")
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit, "feature bigint, weight double, is_bias boolean").collect()
    bias = next((r.weight for r in fitted if r.is_bias), 0.0)
    pairs = sorted((r.feature & (2**64 - 1), r.weight) for r in fitted if not r.is_bias)
    return Model(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], float), bias)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) plus held_out, score and predicted.

    Null and empty texts score the bias.  Text is lower-cased; words are runs
    of letters, so signs stuck to a word do not hide it.  Every row is scored,
    repeated or not.  Columns of ``docs`` other than doc_id and text are not
    used; those named like a new column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known_by_worker: dict[str, WordHashes] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = known_by_worker.setdefault("words", WordHashes())
        return pa.array([shared.value.score(t, known) for t in texts.to_pylist()], pa.float64())

    scored = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
