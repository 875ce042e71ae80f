"""Language identification by error-correcting output codes.

Every language has a codeword of bits, as far from the others as a small search makes it. For each bit a binary classifier,
linear in the frequencies of hashed byte n-grams and words, predicts whether the text's language has a one there. A text is
given the codeword with the least loss over all bits, each bit weighted by how much better than chance its classifier does
on the training rows. The text is ambiguous where the next codeword is nearly as close.

Training rows: of the rows with a text and a language that are not held out, at most SAMPLE_ROWS for each language, chosen by
a hash of id and text (the bound is a parameter; see training); the executors count the buckets of whole texts. Rows with the same id, text
and language train once. Only id, text and language are read.

Defined results: a text that is null or holds no letter (Unicode category L) is `und` with score 0 and counts as ambiguous;
without any training row all texts are. With one training language that one is given. Every row of docs gives one row;
other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import gram_counts
from .training import collect_counts, given_rows, keep_rows, score_texts

SAMPLE_ROWS = 500
SIZES, BITS = (2, 3), 14
UNKNOWN = "und"
#: A text is ambiguous when the best language's share of the scores of the two best is below this.
CLEAR = 0.65


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of -1 and 1: all different splits of the languages in two where there are at most five languages, else the
    random code with the largest least distance of 50."""
    if n == 1:
        return np.ones((1, 1), np.int64)
    if n <= 5:
        splits = [(1, *bits) for bits in itertools.product((-1, 1), repeat=n - 1) if -1 in bits]
        return np.array(splits).T
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(50):
        code = rng.choice((-1, 1), (n, length))
        far = length - code @ code.T
        np.fill_diagonal(far, 2 * length)
        varied = (np.abs(code.sum(axis=0)) < n).all()
        if varied and far.min() > most:
            best, most = code, far.min()
    return best


@dataclass
class Coded:
    names: list[str]
    code: np.ndarray  # a row for each language
    vectors: np.ndarray  # a row for each bucket, a column for each bit
    bias: np.ndarray
    weights: np.ndarray  # of the bits

    def margins(self, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = [scaled(c) @ self.vectors[b] + self.bias if len(b) else self.bias for b, c in texts]
        return np.array(rows).reshape(len(rows), len(self.bias))

    def decode(self, texts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the nearest codeword, its share of the scores, and whether another one is nearly as near."""
        margins = self.margins(texts)
        agree = np.clip(margins[:, None, :] * self.code[None], -30, 30)
        loss = np.log1p(np.exp(-agree)) @ self.weights
        near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)[:, ::-1]
        clear = top[:, 0] >= CLEAR * (top[:, 0] + top[:, 1]) if share.shape[1] > 1 else np.ones(len(share), bool)
        return best, share[np.arange(len(best)), best], ~clear


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of frequencies: a vector of length 1."""
    return np.sqrt(counts / counts.sum())


def features(column) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    return gram_counts(column, SIZES, BITS, lower=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], names: list[str], *, epochs: int = 6, rate: float = 0.5, decay: float = 1e-5, seed: int = 7) -> Coded:
    """All bits' classifiers at once, by AdaGrad on the log loss."""
    langs = sorted(set(names))
    code = codewords(len(langs))
    target = code[[langs.index(x) for x in names]]
    bits = code.shape[1]
    model = Coded(langs, code, np.zeros(((2 << BITS) + 1, bits)), np.zeros(bits), np.ones(bits))
    squares, square_b = np.full(((2 << BITS) + 1, bits), 1e-3), np.full(bits, 1e-3)
    values = [scaled(c) if len(c) else c for _, c in texts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, x = texts[i][0], values[i]
            margin = x @ model.vectors[at] + model.bias if len(at) else model.bias
            slope = -target[i] / (1 + np.exp(np.clip(margin * target[i], -30, 30)))
            square_b += slope * slope
            model.bias -= rate * slope / np.sqrt(square_b)
            step = np.outer(x, slope) + decay * model.vectors[at]
            squares[at] += step * step
            model.vectors[at] -= rate * step / np.sqrt(squares[at])
    right = ((model.margins(texts) * target) > 0).mean(axis=0)
    share = np.maximum((target > 0).mean(axis=0), (target < 0).mean(axis=0))
    model.weights = np.maximum((right - share) / np.maximum(1 - share, 1e-9), 0.05)
    return model


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold: tuple[int, int] = (4, 2), per_label: int = SAMPLE_ROWS) -> Coded | None:
    """hold = (folds, fold) names the held-out rows: crc32 of the id as text modulo folds is fold. None without any row."""
    rows = given_rows(docs, id_col=id_col, text_col=text_col, label_col=lang_col, hold=hold, per_label=per_label)
    names, found = collect_counts(rows, features)
    return fit(found, names) if names else None


def _judge(model: Coded | None, column: pa.Array) -> list[tuple[str, float, bool]]:
    """Language, score and whether it is ambiguous, for texts in which those without a letter are null."""
    held = [i for i, ok in enumerate(column.is_valid().to_pylist()) if ok]
    out = [(UNKNOWN, 0.0, True)] * len(column)
    if model is not None and held:
        best, share, unclear = model.decode(features(column.take(pa.array(held))))
        for i, b, s, u in zip(held, best, share, unclear):
            out[i] = (model.names[b], float(s), bool(u))
    return out


def predict(docs: DataFrame, model: Coded | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, lang_pred, score (0 to 1) and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lettered = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    columns = {"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()}
    return score_texts(lettered, lambda column: _judge(shared.value, column), columns, "lang_pred string, score double, ambiguous boolean", id_col=id_col, text_col="text")


def drop_unclear(docs: DataFrame, model: Coded | None, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has letters and one clear language. Null and empty texts have no letter and go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep_rows(docs.where(F.col(text_col).rlike(r"\p{L}")), lambda column: np.array([not u for _, _, u in _judge(shared.value, column)], bool), text_col=text_col)
    return keep
