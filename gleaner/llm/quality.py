"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte 1-, 2- and 3-grams (3-grams hashed), of the share of
words that repeat the word before them, and of length.  Each indicator is scaled by
its log-count ratio between the classes (naive Bayes), rows are scaled to unit
length, and a linear model with hinge loss is fitted by dual coordinate descent.
Margins of rows that the fit did not see give the logistic scale of the score.

Fitting uses at most ``POSITIVES`` + ``NEGATIVES`` labelled rows and
``labelled.SAMPLE_BYTES`` of text; every row is scored from its whole text, by a
map over its table with the model (two arrays of fixed length) broadcast.

Defined edge cases: null and empty texts have only their length feature and get
a score from it; without usable labels every score is 0.5, with labels of one
class only that class's share; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.kernels import frugal, give_back, prefix_hash, slices, span_hash, text_bytes, words
from gleaner.llm.labelled import fit_logistic, labelled_sample

POSITIVES, NEGATIVES = 3000, 3000
GRAM_BITS = 16
_GRAM1, _GRAM2 = 0, 256
_GRAM3 = _GRAM2 + 65536
_REPEAT = _GRAM3 + (1 << GRAM_BITS)
_LENGTH = _REPEAT + 16
N_FEATURES = _LENGTH + 64


def features(data: np.ndarray, repeat: float) -> np.ndarray:
    """Numbers of the features that a text has, ascending."""
    seen = np.zeros(N_FEATURES, bool)
    seen[data] = True
    if len(data) > 1:
        pair = data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]
        seen[_GRAM2 + pair] = True
        if len(data) > 2:
            third = (pair[:-1] * np.uint32(256) + data[2:]) * np.uint32(2654435761)
            seen[_GRAM3 + (third >> np.uint32(32 - GRAM_BITS))] = True
    seen[_REPEAT + int(repeat * 15)] = True
    seen[_LENGTH + min(63, int(4 * np.log2(len(data) + 1)))] = True
    return np.flatnonzero(seen).astype(np.int32)


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text's words that equal the word before."""
    if not len(data):
        return np.zeros(len(offsets) - 1)
    starts, ends, first = words(data, offsets)
    hashes = span_hash(prefix_hash(data), starts, ends)
    same = np.zeros(len(hashes) + 1, np.int64)
    same[1:-1] = hashes[1:] == hashes[:-1] if len(hashes) else same[1:-1]
    count = np.diff(first)
    # a text's first word has none before it
    heads = first[:-1][count > 0]
    same[heads] = 0
    total = np.diff(np.concatenate([[0], np.cumsum(same)])[first])
    return total / np.maximum(count, 1)


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    share = repeats(data, offsets)
    return [features(data[a:b], s) for a, b, s in zip(offsets[:-1], offsets[1:], share)]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.ones(N_FEATURES), np.ones(N_FEATURES)]
    for row, label in zip(rows, y):
        counts[label][row] += 1
    return np.log(counts[1] / (y.sum() + 2)) - np.log(counts[0] / ((1 - y).sum() + 2))


def dual_coordinate_descent(rows, ratio, y, C: float = 1.0, rounds: int = 12, seed: int = 7):
    """(weights, bias) of the hinge-loss model over scaled indicators of unit rows."""
    w, bias = np.zeros(N_FEATURES), 0.0
    sign = 2.0 * y - 1.0
    norm = [1 / np.sqrt((ratio[row] ** 2).sum() + 1e-9) for row in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            scaled = ratio[rows[i]] * norm[i]
            gradient = sign[i] * (w[rows[i]] @ scaled + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), C)  # unit row and bias: Q = 2
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * scaled
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class QualityModel:
    """Margins and scores of feature rows."""

    def __init__(self, ratio, weights, bias: float, a: float, b: float):
        self.ratio, self.bias, self.a, self.b = ratio, bias, a, b
        self.square, self.product = ratio**2, ratio * weights

    def margin(self, row: np.ndarray) -> float:
        return self.product[row].sum() / np.sqrt(self.square[row].sum() + 1e-9) + self.bias

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.margin(r) for r in rows])
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -30, 30)))


def fit(texts: list[str], y: np.ndarray, share: float) -> QualityModel:
    """Fit on three quarters of the rows, set the score's scale on the rest."""
    zero = np.zeros(N_FEATURES)
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else min(max(share, 0.01), 0.99)
        return QualityModel(zero, zero, 0.0, 0.0, float(np.log(p / (1 - p))))
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    rows = []
    for a, b in slices(offsets):
        rows += feature_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    test = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~test])) < 2 or len(np.unique(y[test])) < 2:
        test = np.zeros(len(y), bool)
    train = np.flatnonzero(~test)
    fitted = [rows[i] for i in train]
    ratio = log_count_ratio(fitted, y[train])
    w, bias = dual_coordinate_descent(fitted, ratio, y[train])
    model = QualityModel(ratio, w, bias, 1.0, 0.0)
    check = np.flatnonzero(test) if test.any() else train
    margins = np.array([model.margin(rows[i]) for i in check])
    # the sample's classes are weighed back to their share among all labelled rows
    mine = y[check]
    weight = np.where(mine == 1, share / max(mine.mean(), 1e-9), (1 - share) / max(1 - mine.mean(), 1e-9))
    model.a, model.b = fit_logistic(margins, mine, weight)
    return model


def fit_quality(documents: DataFrame, labels: DataFrame, usable, label: str = "quality") -> QualityModel:
    model = fit(*labelled_sample(documents, labels, label, usable, POSITIVES, NEGATIVES))
    give_back()  # what the sample took of the driver
    return model


def score_texts(df: DataFrame, model, rows_of=feature_rows, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the model's score of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            scores = [np.zeros(0)]
            for a, b in slices(offsets):
                scores.append(own.score(rows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
            columns = [*batch.columns, pa.array(np.concatenate(scores), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = df.drop(score)
    names, place = [*kept.columns, score], kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{score}` double"
    return kept.mapInArrow(frugal(run), schema)
