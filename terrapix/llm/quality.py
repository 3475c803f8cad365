"""Document quality by naive Bayes support vectors.

Indicators of hashed n-grams, over characters and over runs of character classes, are scaled by class log-count ratios, and a linear model with hinge loss is fitted on
the scaled indicators by dual coordinate descent. Part of the sample is held back to turn margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .ngrams import chunks, codepoints

SIZES = (1, 2, 3)
SHAPE_SIZES = (3, 6, 10)
FEATURE_BITS = 16
MAX_ROWS = 6_000
MAX_CHARS = 12_000_000
ALPHA = 1.0
C = 1.0
EPOCHS = 15


_classes: np.ndarray | None = None


def shape(points: np.ndarray) -> np.ndarray:
    """Runs of lower-case letters, other letters, digits and white space as one symbol each; every other character as itself."""
    global _classes
    if _classes is None:
        kinds = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                kinds[c] = 97 if x.lower() == x else 65
            elif x.isdigit():
                kinds[c] = 57
            elif x.isspace():
                kinds[c] = 10 if x == "\n" else 32
        _classes = kinds
    k = _classes[points]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return k[new]


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted ids of the n-grams that occur in the whole text; seen is a cleared scratch array of booleans."""
    shift = np.uint64(64 - FEATURE_BITS)
    points = codepoints(text or "")
    for symbols, sizes in ((points, SIZES), (shape(points), SHAPE_SIZES)):
        for h in chunks(symbols, sizes):
            seen[(h >> shift).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of a hinge-loss linear model over sparse rows (ids, values); y is -1 or 1, c the bound of each row's dual."""
    w, a = np.zeros(size), np.zeros(len(rows))
    q = np.array([float(v @ v) for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if not q[i]:
                continue
            ids, v = rows[i]
            g = y[i] * float(v @ w[ids]) - 1
            new = min(max(a[i] - g / q[i], 0.0), c[i])
            if new != a[i]:
                w[ids] += (new - a[i]) * y[i] * v
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of P(1) = 1 / (1 + exp(-(slope * margin + shift))) by damped Newton steps on smoothed targets."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - t, p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(d * margin).sum(), d.sum()]))
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


class QualityModel:
    def __init__(self, texts: list[str | None], labels: list[int]):
        size = 1 << FEATURE_BITS
        self.ratio, self.weight, self.bias, self.slope, self.shift = np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            self.shift = 4.0 * (float(y.mean()) * 2 - 1) if len(y) else 0.0
            return
        seen = np.zeros(size, bool)
        found = [indicators(t, seen) for t in texts]
        fit = np.arange(len(y)) % 5 != 4
        if len(set(y[fit])) < 2 or len(set(y[~fit])) < 2:
            fit = np.ones(len(y), bool)
        p, q = np.full(size, ALPHA), np.full(size, ALPHA)
        for ids, label, use in zip(found, y, fit, strict=True):
            if use:
                (p if label else q)[ids] += 1
        self.ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        rows = []
        for ids in found:
            v = self.ratio[ids]
            norm = float(np.sqrt(v @ v)) or 1.0
            rows.append((np.append(ids, size), np.append(v / norm, 1.0)))
        n = int(fit.sum())
        share = {1: n / (2 * int(y[fit].sum())), 0: n / (2 * int(n - y[fit].sum()))}
        mine = np.flatnonzero(fit)
        w = dual_coordinate_descent([rows[i] for i in mine], np.where(y[mine] == 1, 1.0, -1.0), size + 1, np.array([C * share[int(k)] for k in y[mine]]))
        self.weight, self.bias = w[:size] * self.ratio, float(w[size])
        rest = ~fit if not fit.all() else fit
        margins = np.array([self.margin(ids) for ids, use in zip(found, rest, strict=True) if use])
        self.slope, self.shift = sigmoid_fit(margins, y[rest])

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        return float(self.weight[ids].sum() / (np.sqrt(r @ r) or 1.0)) + self.bias

    def score(self, text: str | None, seen: np.ndarray) -> float:
        z = self.slope * self.margin(indicators(text, seen)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Learns from docs (doc_id, text) and labels (doc_id, label: 0 or 1), on a sample bounded by max_rows and max_chars."""
    got = labelled_sample(docs, labels, max_rows, max_chars, 4)
    return QualityModel([t for _, t, _ in got], [int(x) for *_, x in got])


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """Adds a score (0 to 1), under the name into, to docs (text, ...) from the whole text.

    Null texts count as empty, and every row gets a score, repeated ones too; an empty table gives an empty one. Other columns
    are passed on unread, but one named like into is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(1 << FEATURE_BITS, bool)
        for t in texts:
            yield pd.Series([sent.value.score(x, seen) for x in t], dtype="float64")

    return docs.withColumn(into, rate("text"))
