"""Language identification with language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: each slot is a bitmask over languages, so one lookup of an n-gram (the AND of its k
slots) returns all languages that contain it. Over a text, the bits set for each language are counted; the expected number
of false positives is subtracted, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import chunks, codepoints

SIZES = (2, 3, 4)
SLOT_BITS = 19
PROBES = 3
MAX_ROWS = 4_000
MAX_CHARS = 6_000_000
MAX_LANGUAGES = 1000
MIN_SHARE = 2e-5
RATIO = 0.25
UNKNOWN = "und"

_alpha: np.ndarray | None = None


def _prepared(text: str) -> np.ndarray:
    """Lower-cased code points with every non-letter as a space."""
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(c).isalpha() for c in range(0x110000)])
    points = codepoints(text.lower())
    return np.where(_alpha[points], points, np.uint32(32))


class LanguageFilter:
    """Bit-sliced Bloom filter over at most 64 languages a plane."""

    def __init__(self, members: dict[str, np.ndarray], slot_bits: int = SLOT_BITS, probes: int = PROBES):
        self.languages = sorted(members)
        self.slot_bits, self.probes = slot_bits, probes
        self.planes = np.zeros((-(-len(self.languages) // 64) or 1, 1 << slot_bits), np.uint64)
        rates = []
        for k, name in enumerate(self.languages):
            slots, bit = self.planes[k // 64], np.uint64(1 << k % 64)
            for at in self._slots(members[name]):
                slots[at] |= bit
            rates.append(float(np.mean((slots & bit) != 0)) ** probes)
        self.false_positive = np.array(rates)

    def _slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64((1 << self.slot_bits) - 1)
        for p in range(self.probes):
            yield ((h >> np.uint64(p * self.slot_bits)) & mask).astype(np.int64)

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """(planes, n) bitmasks of all languages that contain each n-gram, false positives included."""
        out = None
        for at in self._slots(h):
            out = self.planes[:, at] if out is None else out & self.planes[:, at]
        return out

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """For each language the n-grams it contains, corrected for false positives, and the number of n-grams."""
        found, n = np.zeros(len(self.languages)), 0
        for h in chunks(_prepared(text), SIZES):
            masks = self.languages_of(h)
            n += len(h)
            for k in range(len(self.languages)):
                found[k] += np.count_nonzero(masks[k // 64] & np.uint64(1 << k % 64))
        f = self.false_positive
        return np.maximum(found - n * f, 0) / np.maximum(1 - f, 1e-9), n

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the corrected counts); und with 0 for texts without letters or a filter without languages."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        found, _ = self.counts(text)
        best = int(np.argmax(found))
        return self.languages[best], float(found[best] / found.sum()) if found.sum() else 0.0


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, seed: int = 3, max_languages: int = MAX_LANGUAGES) -> LanguageFilter:
    """Learns from rows (doc_id, text, lang) with a text and a lang.

    A share of each language's rows, picked by a hash of doc_id, is gathered, so that in expectation at most max_rows rows and
    max_chars characters reach the driver; texts of over max_chars / 20 characters are no part of it. Of more than
    max_languages values of lang the most frequent are learned. An n-gram belongs to a language if it makes up at least MIN_SHARE of its n-grams
    and RATIO of the largest share it has in any language, which keeps strays from mislabelled rows out.
    """
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.length("text") <= max(1, max_chars // 20)).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not sizes:
        return LanguageFilter({})
    shares = [(lang, int(1_000_000 * min(1.0, max_rows / len(sizes) / n, max_chars / len(sizes) / max(c, 1)))) for lang, n, c in sizes]
    least = F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, least long"))  # max_languages rows at most
    picked = rows.join(least, "lang").filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < F.col("least"))
    texts: dict[str, list[str]] = {}
    for lang, text in picked.select("lang", "text").collect():
        texts.setdefault(lang, []).append(text)
    shares = {}
    for lang, own in texts.items():
        h = np.concatenate([np.zeros(0, np.uint64)] + [x for n in SIZES for x in chunks(_prepared("  ".join(own)), (n,))])
        keys, n = np.unique(h, return_counts=True)
        shares[lang] = keys[n >= MIN_SHARE * len(h)], n[n >= MIN_SHARE * len(h)] / max(len(h), 1)
    every = np.unique(np.concatenate([k for k, _ in shares.values()])) if shares else np.zeros(0, np.uint64)
    top = np.zeros(len(every))
    for k, s in shares.values():
        at = np.searchsorted(every, k)
        top[at] = np.maximum(top[at], s)
    return LanguageFilter({lang: k[s >= RATIO * top[np.searchsorted(every, k)]] for lang, (k, s) in shares.items()})


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Adds lang_pred and score to docs (text, ...) from the whole text; every other column is passed on unread.

    Null texts and texts without a letter are und with score 0. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([sent.value.predict(x) for x in t], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], predict("text").alias("_p")).select(*[F.col(f"`{c}`") for c in kept], "_p.lang_pred", "_p.score")
