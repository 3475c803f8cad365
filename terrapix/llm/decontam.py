"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

A leak holds both the question and the answer of a test item, so the longer of the two finds it, wherever in a document the
other stands; the shorter is often a few words that are everywhere. The longer part is cut into segments of at most SEGMENT
words, indexed in an inverted index whose postings carry each term's BM25 impact as a share of the segment's own score, so
that one threshold serves all. Every passage of a document (PASSAGE words,
one every STRIDE words, so that any SEGMENT consecutive words lie in one) is a query. A passage whose terms' largest impacts
in no group of segments sum to the threshold can match nothing; the others are run through block-max WAND, which returns every
segment at or above the threshold. A retrieved item counts as a leak once its question and its answer are both found in the document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SEGMENT = 32
STRIDE = 32
PASSAGE = 2 * STRIDE
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 64
GROUPS = 256
MAX_BOUNDS = 4_000_000
MAX_INDEX_CHARS = 8_000_000
_words = re.compile(r"[^\W_]+").findall

MATCH = "array<struct<item_id:long,bm25:double,first_word:long,last_word:long,question_overlap:double,answer_overlap:double>>"


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer words: what stands up to and after the last question mark; without one, the last of several sentences is the answer."""
    head, mark, tail = text.rpartition("?")
    if mark and words(head):
        return words(head), words(tail)
    parts = [p for p in re.split(r"(?<=[.!])\s+|\n+", text.strip()) if words(p)]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in words(p)], words(parts[-1])
    return words(text), []


def shingles(ws: list[str]) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


class Index:
    """Inverted index of item segments with impacts, term maxima and block maxima."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.item_ids = [i for i, _ in items]
        self.parts = [question_answer(t or "") for _, t in items]
        self.items = dict(zip(self.item_ids, self.parts, strict=True))
        self.segment_item: list[int] = []
        segments: list[list[str]] = []
        for i, parts in enumerate(self.parts):
            ws = max(parts, key=len)
            n = -(-len(ws) // SEGMENT)
            for k in range(n):
                segments.append(ws[k * len(ws) // n : (k + 1) * len(ws) // n])
                self.segment_item.append(i)
        mean = sum(map(len, segments)) / max(len(segments), 1)
        held: dict[str, list[tuple[int, int]]] = {}
        for s, ws in enumerate(segments):
            for w in dict.fromkeys(ws):
                held.setdefault(w, []).append((s, ws.count(w)))
        own = np.zeros(len(segments))
        self.ids = {w: k + 1 for k, w in enumerate(sorted(held))}
        self.at: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.impact: list[np.ndarray] = [np.zeros(0)]
        for w in sorted(held):
            idf = math.log(1 + (len(segments) - len(held[w]) + 0.5) / (len(held[w]) + 0.5))
            at = np.array([s for s, _ in held[w]])
            impact = np.array([idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segments[s]) / mean)) for s, tf in held[w]])
            own[at] += impact
            self.at.append(at)
            self.impact.append(impact)
        for k in range(1, len(self.at)):
            self.impact[k] = self.impact[k] / own[self.at[k]]
        self.block_max = [[float(x[b : b + BLOCK].max()) for b in range(0, len(x), BLOCK)] for x in self.impact]
        self.most = np.array([float(x.max()) if len(x) else 0.0 for x in self.impact])
        groups = max(1, min(GROUPS, len(segments), MAX_BOUNDS // len(self.at)))
        self.bounds = np.zeros((len(self.at), groups), np.float32)
        for k, (at, x) in enumerate(zip(self.at, self.impact, strict=True)):
            np.maximum.at(self.bounds[k], at % groups, x.astype(np.float32))
        self.at_lists = [x.tolist() for x in self.at]
        self.impact_lists = [x.tolist() for x in self.impact]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every (segment, score) at or above the threshold for the distinct terms, by block-max WAND."""
        least, end, out = self.threshold - 1e-9, len(self.segment_item), []
        cursors = [[self.at_lists[t][0], t, 0] for t in terms if self.at_lists[t]]
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for k, (_, t, _) in enumerate(cursors):
                total += self.most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            bound, jump = 0.0, end
            for c in cursors[: pivot + 1]:
                at, block = self.at_lists[c[1]], c[2] // BLOCK
                while (block + 1) * BLOCK < len(at) and at[(block + 1) * BLOCK - 1] < doc:
                    block += 1
                if at[min((block + 1) * BLOCK, len(at)) - 1] >= doc:
                    bound += self.block_max[c[1]][block]
                    jump = min(jump, at[min((block + 1) * BLOCK, len(at)) - 1] + 1)
            if bound < least:
                # No segment before the end of these blocks, nor before the next list's, can reach the threshold.
                to = min(jump, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                cursors = self._advance(cursors, pivot, max(to, doc + 1))
            elif cursors[0][0] == doc:
                score = sum(self.impact_lists[t][p] for _, t, p in cursors[: pivot + 1])
                if score >= least:
                    out.append((doc, score))
                cursors = self._advance(cursors, pivot, doc + 1)
            else:
                cursors = self._advance(cursors, pivot, doc)
        return out

    def _advance(self, cursors: list[list[int]], last: int, to: int) -> list[list[int]]:
        for c in cursors[: last + 1]:
            if c[0] < to:
                at, p = self.at_lists[c[1]], c[2]
                block = p // BLOCK
                while (block + 1) * BLOCK < len(at) and at[(block + 1) * BLOCK - 1] < to:
                    block += 1
                p = max(p, block * BLOCK)
                while p < len(at) and at[p] < to:
                    p += 1
                c[2] = p
                c[0] = at[p] if p < len(at) else -1
        return [c for c in cursors if c[0] >= 0]

    def _promising(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, end) of the passages whose bound reaches the threshold in some group of segments.

        A passage is two cells of STRIDE words; a term counts once a cell. The largest impacts over all segments are summed
        first, and by group only where those suffice.
        """
        n, least = len(ids), self.threshold - 1e-3
        cells = max(1, -(-n // STRIDE))
        known = np.flatnonzero(ids)
        key = np.unique(known // STRIDE * len(self.at) + ids[known])
        cell, term = key // len(self.at), key % len(self.at)
        most = np.bincount(cell, self.most[term], cells)
        pair = most + np.append(most[1:], 0.0)
        hopeful = np.flatnonzero(pair[: max(cells - 1, 1)] >= least)
        if not len(hopeful):
            return
        lo = np.searchsorted(cell, hopeful)
        hi = np.searchsorted(cell, hopeful + 2)
        for k, a, b in zip(hopeful.tolist(), lo.tolist(), hi.tolist(), strict=True):
            if self.bounds[term[a:b]].sum(axis=0).max() >= least:
                yield k * STRIDE, min(k * STRIDE + PASSAGE, n)

    def leaks(self, text: str | None) -> list[dict]:
        """The verified items in a whole text, one entry an item_id; of several texts of one item_id the best found counts."""
        ws = words(text)
        if not ws or not self.segment_item:
            return []
        get = self.ids.get
        ids = np.array([get(w, 0) for w in ws])
        found: dict[int, list] = {}
        for a, b in self._promising(ids):
            terms = np.unique(ids[a:b])
            for s, score in self.search(terms[terms > 0].tolist()):
                x = found.setdefault(self.segment_item[s], [0.0, a, b])
                x[:] = max(x[0], score), min(x[1], a), max(x[2], b)
        out: dict[int, dict] = {}
        if found:
            have = shingles(ws)
            short = " " + " ".join(ws) + " "
            for item, (score, a, b) in sorted(found.items()):
                q, ans = (self._overlap(x, have, short) for x in self.parts[item])
                i = self.item_ids[item]
                if q >= OVERLAP and ans >= OVERLAP and (i not in out or (min(q, ans), score) > (min(out[i]["question_overlap"], out[i]["answer_overlap"]), out[i]["bm25"])):
                    out[i] = {"item_id": i, "bm25": float(score), "first_word": a, "last_word": b - 1, "question_overlap": q, "answer_overlap": ans}
        return [out[i] for i in sorted(out)]

    @staticmethod
    def _overlap(part: list[str], have: set, joined: str) -> float:
        if len(part) < SHINGLE:
            return float(not part or f" {' '.join(part)} " in joined)
        own = shingles(part)
        return len(own & have) / len(own)


def indexes(items: DataFrame, threshold: float = THRESHOLD, max_chars: int = MAX_INDEX_CHARS) -> Iterator[Index]:
    """Indexes over items (item_id, text), each over at most about max_chars characters: one, unless the items are many."""
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // max_chars))
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        yield Index(sorted((int(i), t) for i, t in own.collect()), threshold)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_index_chars: int = MAX_INDEX_CHARS, into: str = "leaks") -> DataFrame:
    """Adds leaks, under the name into, to docs (text, ...): an array of the benchmark items found and verified in the whole text, empty if none.

    items has item_id and text; rows with a null in either are passed over, and texts that share an item_id are searched
    each, with one entry for all. Null and empty texts have no leaks; repeated rows each get theirs; an empty table gives an
    empty one. Other columns stay, but one named like into is replaced. Each index is broadcast under a bound on its
    characters; more items mean more indexes, each searched by every passage. The rows are stored between two indexes, so
    that no worker ever holds more than one.
    """
    spark = docs.sparkSession
    out = docs.withColumn(into, F.expr(f"CAST(array() AS {MATCH})"))
    scratch = None
    for index in indexes(items, threshold, max_index_chars):
        if scratch:
            out = scratch.write(out)
        scratch = scratch or Scratch(spark, "decontam")
        found = F.concat(into, _finder(spark.sparkContext.broadcast(index))("text"))
        out = out.withColumn(into, F.array_sort(found))
    return out


def _finder(sent):
    @F.pandas_udf(MATCH)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([sent.value.leaks(x) for x in t], dtype="object")

    return run
