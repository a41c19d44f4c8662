"""Quality: a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0).  Its evidence are shape features of the line
and of both neighbours; a transition table ties neighbouring labels.  In
training all lines of a document carry the document's label.  Forward-backward
gives each line's probability of being good; their mean weighted by line
length is the quality of the document.

The field is fitted on a bounded sample (``SAMPLE`` documents) in one group;
its parameters are a few dozen numbers.  Scoring reads every whole text once
and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import held_out, learning_sample

SAMPLE = 4000  # labelled documents used for fitting at most
STEPS = 100
RATE = 0.1
RIDGE = 1e-3
THRESHOLD = 0.7
CHUNK_CHARS = 1_000_000  # texts are scored in chunks of about this size

SHAPE = ("length", "words", "upper", "digits", "signs", "bars", "word_length", "distinct", "seen", "first_word")


def _byte_classes() -> np.ndarray:
    """Row per class: is each byte upper case, a digit, a sign, a bar?  Bytes of other alphabets count as letters."""
    table = np.zeros((4, 256), np.uint8)
    for b in range(128):
        c = chr(b)
        table[0, b] = c.isupper()
        table[1, b] = c.isdigit()
        table[2, b] = c.isprintable() and not c.isalnum() and c not in " .,'|-"
        table[3, b] = c == "|"
    return table


_CLASSES = _byte_classes()


def _word_counts(line: str) -> tuple[int, int, int]:
    """(words, distinct words, words equal to the first)."""
    words = line.split()
    return len(words), len(set(words)), words.count(words[0]) if words else 0


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features per line, line lengths in code points, number of lines per text)."""
    lines, per_text, seen = [], [], []
    for text in texts:
        own = text.split("\n")
        per_text.append(len(own))
        lines += own
        met: set[str] = set()
        for line in own:
            seen.append(line in met)
            met.add(line)
    size = len(lines)
    raw = [line.encode(errors="replace") for line in lines]
    octets = np.array([len(r) for r in raw])
    # A separator behind each line keeps empty lines apart in reduceat.
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.concatenate(([0], np.cumsum(octets + 1)[:-1]))
    counts = [np.add.reduceat(c[data], starts, dtype=np.int64) for c in _CLASSES]
    n_words, distinct, same = np.array([_word_counts(line) for line in lines]).T
    length = np.array([len(line) for line in lines])
    span, many = np.maximum(octets, 1), np.maximum(n_words, 1)
    shape = np.column_stack(
        (
            np.log1p(length),
            np.log1p(n_words),
            counts[0] / span,
            counts[1] / span,
            counts[2] / span,
            counts[3] / span,
            np.log1p(length / many),
            distinct / many * (n_words > 0),
            np.array(seen, float),
            np.where(n_words > 3, same / many, 0.0),
        )
    )
    return shape.reshape(size, len(SHAPE)), length, np.array(per_text)


def with_neighbours(shape: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a constant; zeros beyond the ends of a text."""
    ends = np.cumsum(per_text)
    starts = ends - per_text
    before, after = np.roll(shape, 1, axis=0), np.roll(shape, -1, axis=0)
    before[starts] = 0.0
    after[ends - 1] = 0.0
    return np.hstack((shape, before, after, np.ones((len(shape), 1))))


@dataclass
class Field:
    """mean and scale of the shape features, unary weights (good against bad) and transitions[from, to]."""

    mean: np.ndarray
    scale: np.ndarray
    unary: np.ndarray
    move: np.ndarray

    def evidence(self, shape: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return with_neighbours((shape - self.mean) / self.scale, per_text)

    def line_probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape, length, per_text = line_features(texts)
        good, _, _ = marginals(self.evidence(shape, per_text) @ self.unary, per_text, self.move)
        return good, length, per_text

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        good, length, per_text = self.line_probabilities(texts)
        starts = np.cumsum(per_text) - per_text
        weight = np.maximum(length, 1)
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


def marginals(unary: np.ndarray, per_text: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    Returns P(good) per line, the places of lines that have a line before them
    and the 2 x 2 probabilities of the step to each.  Chains are ordered by
    length, so step t works on those that still have a line t.
    """
    order = np.argsort(-per_text, kind="stable")
    sizes = per_text[order]
    starts = (np.cumsum(per_text) - per_text)[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    node = np.column_stack((np.zeros(len(unary)), unary))
    ahead, back = np.empty_like(node), np.zeros_like(node)
    ahead[starts] = node[starts]
    for t in range(1, longest):
        at = starts[: active[t]] + t
        prev = ahead[at - 1]
        ahead[at] = node[at] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        nxt = node[at + 1] + back[at + 1]
        back[at] = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
    both = ahead + back
    top = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - top)
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    step = ahead[at - 1][:, :, None] + move[None] + (node[at] + back[at])[:, None, :] - top[at][:, None, None]
    return good, at, np.exp(step)


def fit_field(texts: list[str], y: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge, by Adam on the whole sample; classes weigh alike."""
    shape, _, per_text = line_features(texts)
    field = Field(shape.mean(axis=0), shape.std(axis=0) + 1e-6, np.zeros(3 * len(SHAPE) + 1), np.zeros((2, 2)))
    x = field.evidence(shape, per_text)
    label = np.repeat(y, per_text)
    # A document weighs the same whatever its number of lines, and so do both classes in total.
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) / per_text
    weight = np.repeat(share, per_text)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, at, step = marginals(x @ theta[:-4], per_text, theta[-4:].reshape(2, 2))
        step[np.arange(len(at)), label[at - 1], label[at]] -= 1.0
        gradient = np.concatenate((x.T @ ((good - label) * weight), (step * weight[at][:, None, None]).sum(axis=0).ravel()))
        gradient += RIDGE * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta - RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field.unary, field.move = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values("doc_id", kind="stable")
    field = fit_field(sample["text"].tolist(), sample["y"].to_numpy(int))
    return pd.DataFrame({"part": ["mean", "scale", "unary", "move"], "numbers": [a.ravel().tolist() for a in (field.mean, field.scale, field.unary, field.move)]})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = SAMPLE) -> Field:
    """Fit on the learning sample.  Without any labelled document every line is good with probability 0.5."""
    sample = learning_sample(docs, labels, label_col, limit)
    fitted = {r.part: np.array(r.numbers) for r in sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit, "part string, numbers array<double>").collect()}
    if not fitted:
        return Field(np.zeros(len(SHAPE)), np.ones(len(SHAPE)), np.zeros(3 * len(SHAPE) + 1), np.zeros((2, 2)))
    return Field(fitted["mean"], fitted["scale"], fitted["unary"], fitted["move"].reshape(2, 2))


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """Slices of ``texts`` of about ``limit`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def score_quality(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) plus held_out, score and predicted.

    A null or empty text is one empty line and gets that line's probability.
    Lines are weighted by their code points (an empty line by one).  Every row
    is scored, repeated or not.  Columns of ``docs`` other than doc_id and text
    are not used; those named like a new column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(chunk) for chunk in chunks(texts.to_pylist())]
        return pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())

    scored = docs.withColumn("score", score(F.coalesce("text", F.lit(""))))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
