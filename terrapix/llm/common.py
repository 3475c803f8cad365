"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import Scratch, components

__all__ = ["Scratch", "components", "fold", "labelled_sample", "lower_ascii", "text_sample"]


def lower_ascii(text):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_sample(rows: DataFrame, max_rows: int, max_chars: int, seed: int) -> list[tuple]:
    """Rows (doc_id, text, ...) to fit a model on: all while both bounds hold, else a share picked by a hash of doc_id.

    max_rows and max_chars bound what reaches the driver: in expectation, and as texts of over max_chars / 20 characters are
    no part of the sample, with little spread. The share follows from counts over all other rows only.
    """
    rows = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= max(1, max_chars // 20))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(1.0, max_rows / max(n, 1), max_chars / max(chars, 1))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int, seed: int) -> list[tuple]:
    """(doc_id, text, label) of a bounded sample of labels (doc_id, label: 0 or 1), found in docs by a join that leaves the texts where they are.

    Of several labels of a document the largest counts; nulls and other labels are passed over.
    """
    labels = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(labels.count(), 1))
    if share < 1:
        labels = labels.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "label")
    return text_sample(rows, max_rows, max_chars, seed)
