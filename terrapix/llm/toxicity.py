"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, the sigmoid of its words' weights; the document's is their
noisy-or, 1 - prod(1 - p). The weights are trained from document labels alone; the sentences that carry a document's score
are then located.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

MAX_ROWS = 8_000
MAX_CHARS = 24_000_000
MIN_DOCS = 6
SIGNIFICANCE = 5.0
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 200_000
STEPS = 120
RATE = 0.15
L2 = 1e-4
_parts = re.compile(r"[^\W\d_]+|[.!?\n]").findall
_sentence = re.compile(r"[^.!?\n]+").finditer
STOPS = frozenset(".!?\n")
STOP_VALUE = 1e9


def features(word: str) -> set[str]:
    """The word itself and, marked by a hyphen, its beginnings of 3 to 6 letters."""
    return {word} | {f"{word[:k]}-" for k in PREFIXES if len(word) >= k}


class WordSums(dict):
    """Sum of the weights of a word's features, kept for a bounded number of words; sentence ends are marked."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.weights.get
        self[word] = out = STOP_VALUE if word in STOPS else sum(get(x, 0.0) for x in features(word))
        return out


class ToxicityModel:
    """Weights of word features and of an empty sentence."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        self.weights: dict[str, float] = {}
        self.bias = -8.0
        y = np.array(labels, np.float64)
        if not len(y) or not y.sum():
            return
        word_ids: dict[str, int] = {}
        docs = [np.array([-1 if w in STOPS else word_ids.setdefault(w, len(word_ids)) for w in _parts((t or "").lower())], np.int32) for t in texts]
        feature_ids: dict[str, int] = {}
        per_word = [np.array([feature_ids.setdefault(f, len(feature_ids)) for f in features(w)], np.int32) for w in word_ids]
        ends = np.cumsum([len(x) for x in per_word], dtype=np.int64)
        flat = np.concatenate([*per_word, np.zeros(0, np.int32)])
        sizes = np.diff(ends, prepend=0)
        del per_word

        def of_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The features of words, and for each the place of its word in ids."""
            n = sizes[ids]
            place = np.repeat(np.arange(len(ids)), n)
            return flat[np.repeat(ends[ids] - n, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)], place

        counts = np.zeros((2, len(feature_ids)))
        for ids, label in zip(docs, y, strict=True):
            counts[int(label), np.unique(of_words(np.unique(ids[ids >= 0]))[0])] += 1
        n_pos, n_neg = float(y.sum()), max(float(len(y) - y.sum()), 1.0)
        share = counts.sum(axis=0) / len(y)
        gap = np.abs(counts[1] / n_pos - counts[0] / n_neg)
        telling = (counts.sum(axis=0) >= MIN_DOCS) & (gap >= SIGNIFICANCE * np.sqrt(share * (1 - share + 1e-9) * (1 / n_pos + 1 / n_neg)))
        vocabulary = [f for f, k in feature_ids.items() if telling[k]]
        column = np.cumsum(telling) - 1
        del feature_ids, word_ids
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        doc_of, n = [], 0
        for d, ids in enumerate(docs):
            held = ids >= 0
            number = np.unique(np.cumsum(~held)[held], return_inverse=True)[1]
            found, place = of_words(ids[held])
            keep = telling[found]
            parts.append((column[found[keep]], number[place[keep]] + n))
            last = int(number.max()) + 1 if len(number) else 0
            doc_of.append(np.full(last, d))
            n += last
        feature, sentence, doc_of = np.concatenate([x for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts]).astype(np.int64), np.concatenate(doc_of)
        theta = np.zeros(len(vocabulary) + 1)
        theta[-1] = np.log(max(y.mean(), 1e-3) / max(n / len(y), 1))
        m, v = np.zeros(len(theta)), np.zeros(len(theta))
        for step in range(1, STEPS + 1):
            z = np.clip(theta[-1] + np.bincount(sentence, theta[feature], n), -30, 30)
            none = np.exp(-np.bincount(doc_of, np.log1p(np.exp(z)), len(y)))
            pull = np.where(y == 1, none / np.maximum(1 - none, 1e-9), -1.0) / len(y)
            g = pull[doc_of] / (1 + np.exp(-z))
            grad = np.append(np.bincount(feature, g[sentence], len(vocabulary)), g.sum()) - L2 * theta * np.append(np.ones(len(vocabulary)), 0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        self.bias = float(theta[-1])
        self.weights = {x: float(theta[k]) for k, x in enumerate(vocabulary)}

    def sums(self) -> WordSums:
        """The sums of words, kept with the model for as long as a worker process holds it."""
        if "_sums" not in self.__dict__:
            self._sums = WordSums(self.weights)
        return self._sums

    def score(self, text: str | None, sums: WordSums) -> float:
        """Noisy-or over the whole text's sentences; 0 without words."""
        values = np.array(list(map(sums.__getitem__, _parts((text or "").lower()))), np.float64)
        stop = values == STOP_VALUE
        if stop.all():
            return 0.0
        number = np.cumsum(stop)[~stop]
        z = self.bias + np.bincount(number, values[~stop])[np.flatnonzero(np.bincount(number))]
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def offending(self, text: str | None, sums: WordSums, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at or above least, in code points; else of the likeliest one."""
        out = []
        for s in _sentence(text or ""):
            ws = _parts_of(s[0].lower())
            if ws:
                z = self.bias + sum(sums[w] for w in ws)
                out.append((s.start(), s.end(), float(1 / (1 + np.exp(-np.clip(z, -30, 30))))))
        return [x for x in out if x[2] >= least] or ([max(out, key=lambda x: x[2])] if out else [])


def _parts_of(sentence: str) -> list[str]:
    return [w for w in _parts(sentence) if w not in STOPS]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learns from docs (doc_id, text) and labels (doc_id, label: 0 or 1), on a sample bounded by max_rows and max_chars."""
    got = labelled_sample(docs, labels, max_rows, max_chars, 6)
    return ToxicityModel([t for _, t, _ in got], [int(x) for *_, x in got])


def score(docs: DataFrame, model: ToxicityModel, locate: bool = True, into: str = "score") -> DataFrame:
    """Adds a score (0 to 1) under the name into and, if locate, offending (array of start, end, score; empty below 0.5) to docs.

    Null and empty texts have score 0. Every row gets a score from its whole text; other columns are passed on unread, and
    columns of the names given are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        sums = m.sums()
        for t in texts:
            scores = [m.score(x, sums) for x in t]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in m.offending(x, sums)] if locate and s >= 0.5 else [] for x, s in zip(t, scores, strict=True)]
            yield pd.DataFrame({"score": scores, "offending": spans})

    kept = [F.col(f"`{c}`") for c in docs.columns if c != into and not (locate and c == "offending")]
    out = docs.select(*kept, rate("text").alias("_rated"))
    return out.select(*kept, F.col("_rated.score").alias(into), *["_rated.offending"] * locate)
