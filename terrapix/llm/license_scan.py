"""License scans by exact set-similarity join, in DataFrame functions only.

A text block is a window of BLOCK words, one every STEP words, so any BLOCK - STEP + 1 consecutive words lie in one block.
A block matches a template when it contains at least THRESHOLD of the template's distinct words. Template words are ordered
by the number of documents that hold them, rarest first, over all documents. With o the overlap a template needs, a match
shares a word among the template's first |T| - o + 1 and the block's first |B| - o + 1 ordered words (prefix filter), |B|
is at least o (length filter), and the words left after the first shared one must suffice (positional filter). Words outside
all templates change no overlap and are left out of |B|. What passes is verified exactly.

Templates of up to BLOCK - STEP words share these blocks. Longer ones are scanned in blocks of their own, twice as wide for
each doubling of a template's words, so that a template of any length lies whole in one of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

BLOCK = 48
STEP = 24
THRESHOLD = 0.9
# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label: sentences by which public licenses are granted or named.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def words_of(text) -> Column:
    spaced = F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _width(words: int, most: int) -> int:
    """The first power of two by which a block must grow to hold so many words wherever they start."""
    width = 1
    while words > most * width:
        width *= 2
    return width


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    test = lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase
    held = F.array_contains(words, parts[0])
    for p in parts[1:]:
        held = held & F.array_contains(words, p)
    first = lambda i: F.get(words, i) == parts[0]
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), lambda i: first(i) & test(i))
    return F.when(held, found).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, step: int = STEP) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches is an array of (template number, first word of the block, containment), ordered, of every matching block; labels
    joins base_labels with the templates'. score is 1 where a base phrase stands, else the largest containment of a matching
    block, else 0. Null and empty texts have no words, null first_word and last_word, and empty labels. Repeated rows each
    give a row; further columns are ignored. An empty table gives an empty result. Blocks have the given width and step for
    templates of up to block - step words, and for longer ones the first power of two times as much that holds them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    sets = [list(dict.fromkeys(t.split())) for _, t in templates]
    widths = [_width(len(t.split()), block - step) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    texts = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    counts = texts.select(F.explode(F.array_intersect(_array(vocabulary), "words")).alias("w")).groupBy("w").count()
    frequency = {r["w"]: r["count"] for r in counts.collect()}  # at most one row a template word
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    sets = [sorted(s, key=rank.get) for s in sets]
    needs = [max(1, -int(-threshold * len(s) // 1)) for s in sets]
    prefixes = sorted({w for s, o in zip(sets, needs, strict=True) for w in s[: len(s) - o + 1]}, key=rank.get)

    labels = [_places(F.col("words"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    none = F.expr("CAST(array() AS array<struct<at:int,width:int,has:array<string>>>)")

    def cut(width: int) -> Column:
        """The blocks of a width, with the template words of that width that each holds; those that can match something."""
        own = [w for w in order if any(w in s for s, x in zip(sets, widths, strict=True) if x == width)]
        least = [w for w in prefixes if any(w in s[: len(s) - o + 1] for s, o, x in zip(sets, needs, widths, strict=True) if x == width)]
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step * width))
        every = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(width).alias("width"), F.array_intersect(_array(own), F.slice("words", i + 1, block * width)).alias("has")))
        return F.when(F.arrays_overlap("words", _array(least)), F.filter(every, lambda b: F.arrays_overlap(b["has"], _array(least)))).otherwise(none)

    blocks = F.concat(none, *[cut(width) for width in sorted(set(widths))])
    rows = scratch.write(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), *labels, blocks.alias("blocks")))

    postings = [F.struct(F.lit(s[i]).alias("w"), F.lit(x).alias("width"), F.lit(k).alias("t"), F.lit(len(s)).alias("size"), F.lit(o).alias("need"), F.lit(i).alias("i")) for k, (s, o, x) in enumerate(zip(sets, needs, widths, strict=True)) for i in range(len(s) - o + 1)]
    postings = spark.range(1).select(F.explode(F.array(*postings)).alias("p")).select("p.*")
    found = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*").select("row", "at", "width", "has", F.size("has").alias("n"), F.posexplode("has").alias("j", "w"))
    near = found.join(F.broadcast(postings), ["w", "width"]).filter((F.col("n") >= F.col("need")) & (F.col("j") <= F.col("n") - F.col("need")))
    near = near.groupBy("row", "at", "t").agg(F.min(F.struct("j", "i", "n", "size", "need", "has")).alias("x"))
    near = near.filter(F.expr("1 + least(x.size - x.i, x.n - x.j) - 1 >= x.need"))
    template = F.element_at(F.array(*[_array(s) for s in sets]), F.col("t") + 1)
    verified = near.select("row", "at", "t", (F.size(F.array_intersect(template, F.col("x.has"))) / F.col("x.size")).alias("share"), F.size(F.array_intersect(template, F.col("x.has"))).alias("o"), F.col("x.need").alias("need")).filter("o >= need")
    names = F.element_at(_array([label for label, _ in templates]), F.col("t") + 1)
    matches = verified.groupBy("row").agg(F.max("share").alias("best"), F.collect_set(names).alias("named"), F.sort_array(F.collect_list(F.struct("t", F.col("at").cast("long").alias("at"), "share"))).alias("matches"))

    places = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    base = F.concat(*[F.when(F.size(f"p{k}") > 0, _array([label])).otherwise(_array([])) for k, label in enumerate(PHRASES.values())])
    rows = rows.select("row", "doc_id", "n_words", places.alias("places"), F.array_sort(base).alias("base"))
    out = rows.join(matches, "row", "left")
    n = F.size("places").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n.alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("named", _array([])))), ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("matches", F.expr("CAST(array() AS array<struct<t:int,at:bigint,share:double>>)")).alias("matches"),
    )


def oracle(threshold: float = THRESHOLD, block: int = BLOCK, step: int = STEP) -> str:
    """DuckDB SQL of the query's rows: every block against every template."""
    temps = ", ".join(f"({k}, '{label}', string_split('{t}', ' '))" for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return f"""
WITH t(k, label, ws) AS (VALUES {temps}), tt AS (SELECT k, label, list_distinct(ws) AS ws FROM t), p(phrase, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, list_distinct(list_slice(w, g + 1, g + {block})) AS bw FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), {step})) AS g FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(ws, bw)) / len(ws) AS share FROM b, tt WHERE list_has_any(bw, ws) AND len(list_intersect(ws, bw)) >= ceil({threshold} * len(ws) - 1e-9)),
mm AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS named FROM m GROUP BY doc_id),
h AS (SELECT doc_id, g, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS g FROM d), p WHERE array_to_string(list_slice(w, g + 1, g + len(string_split(phrase, ' '))), ' ') = phrase),
hh AS (SELECT doc_id, count(*) AS n, min(g) AS lo, max(g) AS hi, list(DISTINCT label) AS base FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(named, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN mm USING (doc_id) LEFT JOIN hh USING (doc_id)"""
