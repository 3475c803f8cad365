"""Best-fit-decreasing packing of tokenised documents into sequences.

Best-fit decreasing looks at lengths only, and a length is at most the sequence size, so the plan is made from the
histogram of lengths: at most max_tokens numbers, whatever the corpus. Items of one length are placed together. A segment
tree over remaining capacities finds the tightest open bin in logarithmic time; bins that are alike are held as runs, so a
plan has few segments. A second pass numbers the items of each length (split over salts, so that a frequent length does not
meet in one task) and reads each item's bin and offset off the plan.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MAX_TOKENS = 4096
END_ID = 1
CACHE_WORDS = 400_000
SALT_ROWS = 256
MAX_SALTS = 1 << 16


class CapacityTree:
    """Segment tree over capacities 0..size: which capacities have open bins, and the smallest of those at least x."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += bins
            k >>= 1

    def tightest(self, least: int) -> int | None:
        k = least + self.leaves
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], size: int = MAX_TOKENS) -> np.ndarray:
    """Segments (length, first item, items, first bin, items per bin, offset) of best-fit decreasing, sorted by the first two.

    Item i of a segment goes to bin first_bin + i // per_bin at offset + (i % per_bin) * length.
    """
    tree, runs, bins, plan = CapacityTree(size), {}, 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted((x for x in histogram if x), reverse=True):
        left, done = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per, used = size // length, 0
                first, n, room = bins, -(-left // per), size
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
                per, used = room // length, size - room
                if n * per > left:
                    need = -(-left // per)
                    put(room, first + need, n - need)
                    n = need
            items = min(left, n * per)
            plan.append((length, done, items, first, per, used))
            full, rest = divmod(items, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            done, left = done + items, left - items
    if not plan:
        return np.zeros((0, 6), np.int64)
    plan.sort()
    return np.array(plan, np.int64)


def _letters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


class WordEncoder:
    """Ids of a lower-casing word-end BPE, by a cache of words.

    Only texts of Latin letters without special tokens take the cached path, where splitting here and in the tokenizer agree;
    any other text, or another kind of tokenizer, goes to the tokenizer whole. The cache is dropped when it is full.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cut = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and cut == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None]
        letter, number = _letters("L"), _letters("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        self.odd = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85İ]|<\\|").search
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.byte_chars = {b: (b if b in kept else next(spare)) for b in range(256)}
        self.cache: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        seen = word.encode().decode("latin-1").translate(self.byte_chars)
        out = self.cache[word] = np.array([x.id for x in self.tokenizer.model.tokenize(seen)], "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, new = self.cache.get, self._new
        return b"".join([get(w) or new(w) for w in self.words(text.lower())])


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that its cache outlives a task."""
    return WordEncoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs (doc_id, text, ...); ids is binary, little-endian unsigned 32-bit numbers.

    A document's ids end with end_id; only documents of more than max_tokens ids are cut. Null text counts as empty: one
    piece holding end_id. Repeated rows each give their own pieces. tokenizer is a path on every executor, or a file name
    that public_tokenizers knows.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        encoder = word_encoder(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        end, width = end_id.to_bytes(4, "little"), 4 * max_tokens
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                part = batch.slice(at, 1024)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    out += [(doc_id, k // width, k // 4, len(ids[k : k + width]) // 4, ids[k : k + width]) for k in range(0, len(ids), width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def packed(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces, which need a column length (long, 1..max_tokens).

    The plan's size is bounded by max_tokens; the pieces stay distributed. pieces is stored once, so its columns should be
    the ones wanted in the result. All other columns stay as they are, whatever their names, but columns named sequence_id or
    offset are replaced. Repeated rows are packed each; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    held = F.struct(*[F.col(f"`{x}`") for x in pieces.columns if x not in ("sequence_id", "offset")])
    stored = scratch.write(pieces.select(held.alias("piece"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("_row")))
    n = stored.count()
    salts = min(MAX_SALTS, max(1, -(-n // SALT_ROWS)))
    salted = stored.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    groups = scratch.write(salted.groupBy("length", "_salt").count())
    histogram = {int(a): int(b) for a, b in groups.groupBy("length").agg(F.sum("count")).collect()}
    plan = best_fit_plan(histogram, max_tokens)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")
    bases = scratch.write(groups.select("length", "_salt", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_own", own).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    sent = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = sent.value
        stride = int(p[:, 1].max()) + int(p[:, 2].max()) + 1
        size, item = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(p[:, 0] * stride + p[:, 1], size * stride + item, side="right") - 1
        seg, i = p[at], item - p[at, 1]
        return pd.DataFrame({"sequence_id": seg[:, 3] + i // seg[:, 4], "offset": seg[:, 5] + i % seg[:, 4] * size})

    out = ranked.withColumn("_at", place("length", "_rank"))
    own_columns = [F.col("piece").getField(x).alias(x) for x in pieces.columns if x not in ("sequence_id", "offset")]
    return out.select(*own_columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
