"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the first 4, 5, 6 and 8 bytes of longer words (so that endings do not hide a
stem), hashed to 32 bits. The model keeps the terms that tell the labels apart in the training rows and scores

    s = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,    x_i = 1 where the text has term i, else 0

so that two terms together can weigh more or less than one by one. The score is 1 / (1 + exp(-s)). It is fitted with
AdaGrad on the log loss, by numpy on the driver.

Training rows: of the labelled rows that are not held out, at most SAMPLE_ROWS for each label, chosen by a hash of id and
text (the bound is a parameter; see training); whole texts are turned into terms by the executors. Only text and label are read. Rows with
the same id, text and label train once.

Defined results: a null or wordless text has no terms and the score of w0 alone. Rows without a label, or whose id has
no labelled row, train nothing; an id with several labels trains with each. With no training rows of one of the labels
every score is the share of the label 1 (0 without any). Every row of docs gives one row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import ALNUM, hashed_stems
from .training import collect_terms, keep_rows, labelled_rows, score_texts

SAMPLE_ROWS = 2000
STEMS = (4, 5, 6, 8)
#: Terms the model keeps at most, those with the largest likelihood ratio.
KEPT_TERMS = 2000
RANK = 4


def text_terms(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct terms of each text."""
    out: list[np.ndarray] = []
    for first, last, hashes, bounds, _, _ in hashed_stems(column, ALNUM, STEMS):
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(last - first):
            own = np.unique(short[:, bounds[i] : bounds[i + 1]])
            out.append(own[1:] if len(own) and own[0] == 0 else own)
    return out


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # one row a term

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given by their terms."""
        out = np.full(len(found), self.bias)
        if len(self.terms):
            for i, own in enumerate(found):
                at = self.places(own)
                v = self.factors[at]
                total = v.sum(axis=0)
                out[i] += self.weights[at].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def places(self, own: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, own)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == own]


def likelihood_ratio(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int) -> np.ndarray:
    """How much better each term's counts are explained by one rate for each label than by one rate for both."""

    def entropy(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / n), 0) + np.where(k < n, (n - k) * np.log((n - k) / n), 0)

    both = entropy(positive + negative, n_positive + n_negative)
    return 2 * (entropy(positive, n_positive) + entropy(negative, n_negative) - both)


def fit(found: list[np.ndarray], labels: np.ndarray, *, kept: int = KEPT_TERMS, epochs: int = 40, rate: float = 0.2, decay: float = 1e-3, seed: int = 7) -> Machine:
    labels = np.asarray(labels, np.int64)
    ones, zeros = int(labels.sum()), int(len(labels) - labels.sum())
    if not ones or not zeros:
        share = (ones + 1e-9) / (len(labels) + 1e-6)
        return Machine(np.zeros(0, np.uint32), float(np.log(share / (1 - share + 1e-9) + 1e-12)), np.zeros(0), np.zeros((0, RANK)))
    flat = np.concatenate(found)
    label_of = np.repeat(labels, [len(x) for x in found])
    terms, where = np.unique(flat, return_inverse=True)
    positive = np.bincount(where[label_of == 1], minlength=len(terms))
    negative = np.bincount(where[label_of == 0], minlength=len(terms))
    gain = likelihood_ratio(positive, negative, ones, zeros)
    telling = np.flatnonzero((gain > 10.8) & (positive + negative >= 3))  # one in a thousand by chance
    best = np.sort(telling[np.argsort(-gain[telling], kind="stable")[:kept]])
    rng = np.random.default_rng(seed)
    machine = Machine(terms[best], float(np.log(ones / zeros)), np.zeros(len(best)), rng.normal(0, 0.02, (len(best), RANK)))
    places = [machine.places(x) for x in found]
    squares_w, squares_v, square_b = np.full(len(best), 1e-2), np.full((len(best), RANK), 1e-2), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(places)):
            at = places[i]
            v = machine.factors[at]
            total = v.sum(axis=0)
            s = machine.bias + machine.weights[at].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
            slope = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - labels[i]
            if abs(slope) < 1e-4:
                continue
            square_b += slope * slope
            machine.bias -= rate * slope / np.sqrt(square_b)
            step = slope + decay * machine.weights[at]
            squares_w[at] += step * step
            machine.weights[at] -= rate * step / np.sqrt(squares_w[at])
            step_v = slope * (total - v) + decay * v
            squares_v[at] += step_v * step_v
            machine.factors[at] -= 0.25 * rate * step_v / np.sqrt(squares_v[at])
    return machine


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold: tuple[int, int] = (5, 0), per_label: int = SAMPLE_ROWS) -> Machine:
    """hold = (folds, fold) names the held-out rows: crc32 of the id as text modulo folds is fold."""
    rows = labelled_rows(docs, labels, label_col, id_col=id_col, text_col=text_col, hold=hold, per_label=per_label)
    given, found = collect_terms(rows, text_terms)
    return fit(found, np.array(given))


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return score_texts(docs, lambda column: zip(shared.value.score(text_terms(column))), {"score": pa.float64()}, "score double", id_col=id_col, text_col=text_col)


def drop_toxic(docs: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. Null, empty and wordless texts have the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return keep_rows(docs, lambda column: shared.value.score(text_terms(column)) < threshold, text_col=text_col)
