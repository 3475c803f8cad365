"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and get integer names;
adjacent names are then paired and the distinct pairs named, level by level, until one name is left per document. Two
documents of the same number of blocks carry the same last name if and only if their texts are equal: names are given to
contents, never to hashes. A block's xxhash64 only tells where its name is stored; contents that share a hash are told
apart by comparing them. A name is the content's number in an order that depends on the contents alone, so that the same
corpus gets the same names, however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_CHARS = 4096
#: Parts in which contents are sorted and numbered; the table of their sizes is broadcast.
NAME_PARTS = 65_536


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(norm, size: int):
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(norm) <= size, F.array(norm)).otherwise(cut)


def _named(contents: DataFrame, scratch: Scratch, *by: str) -> DataFrame:
    """Adds name to distinct contents: their number, from 0, in order of a part of their hash and then of by. The sizes of the parts, at most NAME_PARTS rows, tell where each part's numbers begin."""
    stored = scratch.write(contents.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(NAME_PARTS)).cast("int")))
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    named = stored.withColumn("_own", own).join(F.broadcast(starts), "_part")
    named = scratch.write(named.withColumn("name", F.col("_start") + F.col("_own") - 1).drop("_part", "_start", "_own"))
    scratch.drop(stored)
    return named


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, n_blocks, identity, keep_id, group_size, kept, text_sha256,
    text_hash (xxhash64 of the text as it came, empty for null).

    (n_blocks, identity) is equal for equal normalised texts and for no others. Null text counts as empty, and empty texts
    form one group. keep_id is the group's smallest doc_id, null only if all are null; of rows that repeat that doc_id
    exactly one is kept. identity is the same for the same corpus, however it is partitioned. Joins of stored tables are sorted
    ones: none of these has a bound on its size that would let it be broadcast. Further columns of docs are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), normalised(F.col("text")).alias("norm"))
    cut = base.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    contents = cut.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("found"))
    told = contents.select("h", F.size("found").alias("n_contents"), F.posexplode("found").alias("place", "block"))
    names = _named(told.select("h", "n_contents", "place", F.when(F.col("n_contents") > 1, F.col("block")).alias("block")), scratch, "h", "place")
    rows = base.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), _blocks(F.col("norm"), block_chars).alias("b"))
    clash = not names.filter("n_contents > 1").isEmpty()
    kept_block = (lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("block"))) if clash else (lambda x: F.struct(F.xxhash64(x).alias("h"), F.lit(None).cast("string").alias("block")))
    rows = scratch.write(rows.select("doc_id", "text_hash", "row", "text_sha256", F.size("b").alias("n"), F.transform("b", kept_block).alias("b")))
    cells = rows.select("row", "n", F.posexplode("b").alias("i", "x")).select("row", "n", "i", "x.h", "x.block")
    one = names.filter("n_contents = 1").select("h", "name")
    placed = cells.join(one.hint("merge"), "h").select("row", "n", "i", "name")
    if clash:
        many = names.filter("n_contents > 1").select("h", "block", "name")
        placed = placed.union(cells.join(many.hint("merge"), ["h", "block"]).select("row", "n", "i", "name"))
    level = scratch.write(placed)
    done = level.filter("n = 1").select("row", "name")
    more = level.filter("n > 1")
    left = more.agg(F.max("n")).first()[0] or 1
    while left > 1:
        pairs = more.groupBy("row", "n", F.expr("i div 2").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("x"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("y"))
        pairs = scratch.write(pairs)
        pair_names = _named(pairs.select("x", "y").distinct(), scratch, "x", "y")
        more = scratch.write(pairs.join(pair_names.hint("merge"), ["x", "y"]).select("row", "n", "i", "name"))
        scratch.drop(pairs, pair_names)
        left = (left + 1) // 2
    if more is not level:
        done = done.union(more.select("row", "name"))
    ident = scratch.write(rows.select("doc_id", "text_hash", "row", "text_sha256", "n").join(done.hint("merge"), "row").select("doc_id", "text_hash", "row", "text_sha256", "n", F.col("name").alias("identity")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = scratch.write(ident.groupBy("n", "identity").agg(first.alias("first"), F.count("*").alias("group_size")).select("n", "identity", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    return ident.join(groups.hint("merge"), ["n", "identity"]).select("doc_id", F.col("n").cast("long").alias("n_blocks"), "identity", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "text_hash")
