"""Quality by supervised subword embeddings.

Byte n-grams and words are hashed to buckets, each with a learned vector. A text's vector is the average over all its
n-grams and words, and a softmax layer over it gives the labels' probabilities. Vectors and layer are trained together by
stochastic gradient descent with a falling rate, by numpy on the driver.

Training rows: of the labelled rows that are not held out, at most SAMPLE_ROWS for each label, chosen by a hash of id and
text (the bound is a parameter; see training); the executors count the buckets of whole texts. Only text and label are read.

Defined results: a null or empty text has the zero vector, so its score is the layer's bias. Rows without a label, or
whose id has no labelled row, train nothing; an id with several labels trains with each. With no training rows of one of
the labels every score is the share of the label 1 (0 without any). Every row of docs gives one row; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import gram_counts
from .training import collect_counts, labelled_rows, score_texts

SAMPLE_ROWS = 2000
SIZES, BITS, WIDTH = (2, 3, 4), 14, 10


@dataclass
class Embedding:
    vectors: np.ndarray  # a row for each bucket
    layer: np.ndarray  # WIDTH x 2
    bias: np.ndarray

    def hidden(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(buckets):
            return np.zeros(self.vectors.shape[1])
        return (counts / counts.sum()) @ self.vectors[buckets]

    def score(self, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probability of the label 1."""
        out = [self.hidden(*x) @ self.layer + self.bias for x in texts]
        odds = np.array([b - a for a, b in out], np.float64)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def features(column) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    return gram_counts(column, SIZES, BITS, lower=False)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, width: int = WIDTH, epochs: int = 15, rate: float = 2.0, seed: int = 7) -> Embedding:
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    ones = int(labels.sum())
    share = (ones + 1e-9) / (len(labels) + 1e-6)
    model = Embedding(rng.uniform(-1 / width, 1 / width, ((2 << BITS) + 1, width)), np.zeros((width, 2)), np.array([0.0, np.log(share / (1 - share + 1e-9) + 1e-12)]))
    if not 0 < ones < len(labels):
        model.vectors[:] = 0
        return model
    steps, done = epochs * len(texts), 0
    shares = [counts / counts.sum() if len(counts) else counts for _, counts in texts]
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            step = rate * (1 - done / steps)
            done += 1
            buckets = texts[i][0]
            hidden = shares[i] @ model.vectors[buckets] if len(buckets) else np.zeros(width)
            out = hidden @ model.layer + model.bias
            slope = np.exp(out - out.max())
            slope /= slope.sum()
            slope[labels[i]] -= 1
            back = model.layer @ slope
            model.layer -= step * np.outer(hidden, slope)
            model.bias -= 0.05 * step * slope
            if len(buckets):
                # A bucket's share is small; the rate is raised to the scale of a text's distinct buckets.
                model.vectors[buckets] -= (step * min(len(buckets), 200)) * np.outer(shares[i], back)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold: tuple[int, int] = (5, 0), per_label: int = SAMPLE_ROWS) -> Embedding:
    """hold = (folds, fold) names the held-out rows: crc32 of the id as text modulo folds is fold."""
    rows = labelled_rows(docs, labels, label_col, id_col=id_col, text_col=text_col, hold=hold, per_label=per_label)
    given, found = collect_counts(rows, features)
    return fit(found, np.array(given))


def score(docs: DataFrame, model: Embedding, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, lambda column: zip(shared.value.score(features(column))), {"score": pa.float64()}, "score double", id_col=id_col, text_col=text_col)
