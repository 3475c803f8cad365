"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most r bits share at least one of r + 1 bit blocks, so each distinct fingerprint joins one
shard per block. A shard's tree is sent to the tasks that query it: one task for a small shard; a large shard is dealt into
chunks, and each chunk's tree goes to every chunk of queries. In a BK-tree a node's children are keyed by their integer
Hamming distance to it; a query follows only edges within the radius of its own distance. The trees of all shards of a task
are built and searched as one forest, level by level, in arrays.

Two searches use this. simhash_components links fingerprints at a small radius. near_components looks for a given similarity of
shingle sets: texts that share 80 % of their shingles differ in 8 bits of 64 on average and no bound holds for all, so bit blocks are
no help. There the shards are dealt by bands of min-hashes and pairs at any distance are looked at. A pair is a candidate if
the share of its equal min-hashes comes near the similarity; what candidates connect is a cluster. Within each cluster the
shingle hashes are compared, and only a pair that has the similarity is a link.

The similarity is one of two. "jaccard" is that of the shingle sets. "covered" is the share of the two texts' words that stand
in a shingle which both texts hold: one changed word takes as many shingles with it as a shingle has words, but leaves all
other words covered, so copies with a changed word in ten still have 0.8, while texts that share a passage have no more than
the passage's share of them. Its candidates are pairs of which the equal min-hashes lie all over both texts.

Min-hashes miss links: of short texts, which have few shingles, and of copies with changes all over. So an exact search goes
over what they leave unconnected (_missed). Shingles that texts of two components hold are put in one order, rare ones first.
Of a linked pair, all shared shingles come no earlier than the first shared one, so at that one what both texts have from there
on suffices for the similarity. Pairs for which it does, at any shingle, are compared by their shingle hashes, and no others: first
those of one text of each component with the text that has most at a shingle, then all that are still in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components

RADIUS = 3
SHINGLE = 3
CHUNK = 2048
SIMILARITY = 0.8
PERMUTATIONS = 256
#: Number of bands and min-hashes in each, by measure. Jaccard: a pair at 0.8 shares a band with a chance of over 0.999.
#: Covered: of pairs at 0.8 few have a Jaccard similarity below 0.4, with a chance of 0.985.
BANDS = {"jaccard": (10, 3), "covered": (24, 2)}
VERIFY_AT_ONCE = 30_000
#: How far the estimate of a candidate may fall short of the similarity: four standard errors of 0.8 from so many min-hashes.
MARGIN = 0.1
#: A candidate of "covered" may have this share of equal min-hashes if they lie in so many sixteenths of both texts.
COVERED_SHARE = 0.25
COVERED_PARTS = 11
#: Bytes of shingle hashes in a chunk of a cluster.
CHUNK_BYTES = 16_000_000
BATCH_BYTES = 64_000_000
_factors = np.random.default_rng(9).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_inverses = np.array([pow(int(x), -1, 2**64) for x in _factors], np.uint64)
BATCH_ROWS = 60_000
#: Occurrences of shingles in a bucket of the exact search. 32 bits tell its shingles apart; those that share them only add pairs to compare.
BUCKET = 1_000_000
OCCURRENCES_AT_ONCE = 500_000
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    return simhash(shingle_hashes(text, shingle))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the hashes under each permutation."""
    best = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 2048):
        best = np.minimum(best, (hashes[k : k + 2048, None] * _factors).min(axis=0))
    return best


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row, text_hash, fp) per row of docs; text_hash is xxhash64 of the text (empty for null), and fp the signed 64-bit reading of the fingerprint."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.fromiter((fingerprint(x, shingle) for x in t), np.uint64, len(t)).view(np.int64))

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fp(F.coalesce(F.col("text"), F.lit(""))).alias("fp"))


def _parts(best: np.ndarray, distinct: np.ndarray, first: np.ndarray, n: int) -> bytes:
    """In which sixteenth of a text of n shingles each min-hash first stands, two to a byte."""
    if not n:
        return bytes(PERMUTATIONS // 2)
    at = first[np.searchsorted(distinct, best * _inverses)] * 16 // n
    return (at[::2] << 4 | at[1::2]).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, shingle: int, measure: str = "jaccard") -> DataFrame:
    """As fingerprints, but fp of the distinct shingles, with sig (a byte of each min-hash and, for "covered", their places), bands (hashes of groups of min-hashes), whole (a hash of all shingles in order) and n (how many these are; for "jaccard", distinct ones)."""
    bands, width = BANDS[measure]

    @F.pandas_udf("fp long, sig binary, bands array<long>, whole long, n long")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            out = []
            for x in t:
                every = shingle_hashes(x, shingle)
                h, first = np.unique(every, return_index=True)
                best = min_hashes(h)
                keys = [xxhash.xxh64_intdigest(best[k * width : (k + 1) * width].tobytes(), k) for k in range(bands)]
                places = _parts(best, h, first, len(every)) if measure == "covered" else b""
                out.append((simhash(h), best.astype(np.uint8).tobytes() + places, np.array(keys, np.uint64).view(np.int64), xxhash.xxh64_intdigest(every.tobytes(), 1), len(every if measure == "covered" else h)))
            fps, whole = (np.array([x[k] for x in out], np.uint64).view(np.int64) for k in (0, 3))
            yield pd.DataFrame({"fp": fps, "sig": [x[1] for x in out], "bands": [x[2] for x in out], "whole": whole, "n": np.array([x[4] for x in out], np.int64)})

    held = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), sketch(F.coalesce(F.col("text"), F.lit(""))).alias("s"))
    return held.select("doc_id", "row", "text_hash", "s.*")


def _with_hashes(docs: DataFrame, members: DataFrame, shingle: int, measure: str) -> DataFrame:
    """members (id, fp, sig, shard, text_hash) with hashes, the shingle hashes of their texts in docs: sorted and distinct for "jaccard", in order for "covered"."""

    @F.pandas_udf("fp long, hashes binary")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            every = [shingle_hashes(x, shingle) for x in t]
            found = [np.unique(h) for h in every]
            yield pd.DataFrame({"fp": np.array([simhash(h) for h in found], np.uint64).view(np.int64), "hashes": [h.tobytes() for h in (every if measure == "covered" else found)]})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = texts.join(members.withColumnRenamed("fp", "_fp"), "text_hash").withColumn("s", sets("text")).filter("s.fp = _fp")
    return held.groupBy("id").agg(*[F.first(x).alias(x) for x in ("shard", "sig")], F.first("s.fp").alias("fp"), F.first("s.hashes").alias("hashes"))


class Forest:
    """BK-trees over fps, one per distinct value of tree. Node ids are positions in fps."""

    def __init__(self, fps: np.ndarray, tree: np.ndarray):
        self.fps = fps
        n = len(fps)
        order = np.argsort(tree, kind="stable")
        first = np.ones(n, bool)
        first[1:] = tree[order][1:] != tree[order][:-1]
        self.tree_keys, self.roots = tree[order][first], order[first]
        rest = order[~first]
        at = self.roots[np.searchsorted(self.tree_keys, tree[rest])]
        edges = []
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            key = at * 65 + d
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.ones(len(rest), bool)
            new[1:] = key[1:] != key[:-1]
            child = rest[new]
            edges.append(np.stack([key[new], child]))
            at = child[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        keys, self.child = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], self.child[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (position of query, node) at most radius bits apart, in parts."""
        spot = np.searchsorted(self.tree_keys, tree)
        spot[spot == len(self.tree_keys)] = 0
        there = np.flatnonzero(self.tree_keys[spot] == tree) if len(self.tree_keys) else np.zeros(0, np.int64)
        todo = [(there[k : k + 4096], self.roots[spot[there[k : k + 4096]]]) for k in range(0, len(there), 4096)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            total = int(n.sum())
            if not total:
                continue
            q = np.repeat(q, n)
            node = self.child[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            todo += [(q[k : k + PAIRS_AT_ONCE], node[k : k + PAIRS_AT_ONCE]) for k in range(0, total, PAIRS_AT_ONCE)]


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; 1 of two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _covered_words(seq: np.ndarray, other: np.ndarray, shingle: int) -> int:
    """How many words of a text, given its shingle hashes in order, stand in a shingle of the other (sorted, distinct)."""
    at = np.searchsorted(other, seq)
    at[at == len(other)] = 0
    held = np.flatnonzero(other[at] == seq)
    return int(np.minimum(np.diff(held), shingle).sum()) + shingle if len(held) else 0


def covered(a: np.ndarray, b: np.ndarray, shingle: int, distinct: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The share of two texts' words, given their shingle hashes in order, that stand in a shingle of both; 1 of two empty ones. A text of fewer words counts as one shingle."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = distinct or (np.unique(a), np.unique(b))
    return (_covered_words(a, y, shingle) + _covered_words(b, x, shingle)) / (len(a) + len(b) + 2 * shingle - 2)


class Check:
    """How pairs of rows are verified: by their sketches, and by their shingle hashes where these are given."""

    def __init__(self, measure: str, least: float, exact: float = 0.0, shingle: int = 5):
        self.measure, self.least, self.exact, self.shingle = measure, least, exact, shingle

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sketches have the share of equal min-hashes, less what chance gives; or, for "covered", enough of them all over both texts."""
        same = a[:, :PERMUTATIONS] == b[:, :PERMUTATIONS]
        share = (same.mean(axis=1) - 1 / 256) * (256 / 255)
        near = share >= self.least
        if self.measure == "covered":
            spread = np.flatnonzero(~near & (share >= COVERED_SHARE))
            for rows in (a, b):
                places = rows[spread, PERMUTATIONS:]
                bits = np.left_shift(1, np.stack([places >> 4, places & 15], axis=2).reshape(len(spread), PERMUTATIONS).astype(np.uint16))
                hit = np.bitwise_or.reduce(np.where(same[spread], bits, 0).astype(np.uint16), axis=1)
                spread = spread[np.bitwise_count(hit) >= COVERED_PARTS]
            near[spread] = True
        return near

    def holds(self, hashes: list[np.ndarray], distinct: dict[int, np.ndarray], i: int, j: int) -> bool:
        """Whether rows i and j have the exact similarity."""
        if self.measure == "jaccard":
            return _jaccard(hashes[i], hashes[j]) >= self.exact
        for k in (i, j):
            if k not in distinct:
                distinct[k] = np.unique(hashes[k])
        return covered(hashes[i], hashes[j], self.shingle, (distinct[i], distinct[j])) >= self.exact


def _stars(ids: np.ndarray, fps: np.ndarray, task: np.ndarray, role: np.ndarray, radius: int, check: Check | None = None, sig: np.ndarray | None = None, hashes: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For the tasks in one batch: (id, id of the first row it is linked to within the task), without loops.

    Pairs within the radius are links; with a check, only those that it finds likely by their sketches and, where hashes are
    given, true. Pairs already connected are not looked at again, so that a dense group costs few verifications.
    """
    trees, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    label = np.arange(len(fps))
    distinct: dict[int, np.ndarray] = {}

    def connect(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]

    forest = Forest(fps[trees], task[trees])
    for q, t in forest.within(fps[asks], task[asks], radius):
        a, b = asks[q], trees[t]
        for k in range(0, len(a), VERIFY_AT_ONCE if check else len(a)):
            x, y = (a[k : k + VERIFY_AT_ONCE], b[k : k + VERIFY_AT_ONCE]) if check else (a, b)
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if check and len(x):
                likely = check.likely(sig[x], sig[y])
                x, y = x[likely], y[likely]
            if hashes is None:
                connect(x, y)
                continue
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if label[i] != label[j] and check.holds(hashes, distinct, i, j):
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return ids[moved], ids[label[moved]]


def _search(cells: DataFrame, scratch: Scratch, radius: int, chunk: int, check: Check | None = None) -> DataFrame:
    """Edges (a, b) that connect, within each shard, exactly the linked rows of cells (id, fp, shard and, for a check, sig and hashes).

    A shard of more than chunk rows or CHUNK_BYTES of hashes is dealt into chunks, and each pair of chunks is a task of its own.
    """
    more = [x for x in ("sig", "hashes") if x in cells.columns]
    kept = ["id", "fp", *more]
    held_bytes = F.sum(F.length("hashes")) if "hashes" in more else F.lit(0)
    chunks = F.ceil(F.greatest(F.count("*") / chunk, held_bytes / CHUNK_BYTES)).cast("int")
    large = scratch.write(cells.groupBy("shard").agg(chunks.alias("chunks")).filter("chunks > 1"))
    if large.isEmpty():
        dealt = cells.select(*kept, "shard", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("role"))
    else:
        held = cells.join(large, "shard", "left").withColumn("c", F.coalesce("chunks", F.lit(1))).withColumn("k", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
        other = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j"), F.when(F.col("k") == o, 0).when(F.col("k") < o, 1).otherwise(2).alias("role"))))
        dealt = held.select(*kept, "shard", other.alias("t")).select(*kept, "shard", "t.i", "t.j", "t.role")
    dealt = dealt.select("id", "fp", F.xxhash64("shard", "i", "j").alias("task"), "shard", "i", "j", "role", *more)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "task").sortWithinPartitions("task", "shard", "i", "j", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list]] = []

        def solve(x: np.ndarray, checks: list) -> pa.RecordBatch:
            new = np.ones(len(x), bool)
            new[1:] = (x[1:, 2:6] != x[:-1, 2:6]).any(axis=1)
            sig = np.frombuffer(b"".join(c[0] for c in checks), np.uint8).reshape(len(x), -1) if more else None
            hashes = [np.frombuffer(c[1], np.uint64) for c in checks] if len(more) > 1 else None
            a, b = _stars(np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1]).view(np.uint64), np.cumsum(new), x[:, 6], radius, check, sig, hashes)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def joined() -> tuple[np.ndarray, list]:
            return np.concatenate([x for x, _ in held]), [c for _, checks in held for c in checks]

        rows = size = 0
        for batch in batches:
            held.append((np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:7]], axis=1), list(zip(*(c.to_pylist() for c in batch.columns[7:]), strict=True))))
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                x, checks = joined()
                last = np.flatnonzero((x[1:, 2:6] != x[:-1, 2:6]).any(axis=1))
                held = [(x, checks)]
                rows, size = len(x), 0
                if len(last):
                    cut = int(last[-1]) + 1
                    yield solve(x[:cut], checks[:cut])
                    held = [(x[cut:], checks[cut:])]
                    rows = len(x) - cut
        if held:
            x, checks = joined()
            if len(x):
                yield solve(x, checks)

    return sorted_.mapInArrow(search, "a long, b long")


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly those within the radius."""
    blocks = radius + 1
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)).alias("v")) for k in range(blocks)]
    spread = distinct.select("fp", F.explode(F.array(*parts)).alias("s")).select(F.col("fp").alias("id"), "fp", (F.col("s.v") * blocks + F.col("s.block")).alias("shard"))
    return _search(spread, scratch, radius, chunk)


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, fp (signed 64-bit), component_id, kept, text_hash.

    Documents whose fingerprints differ in at most radius bits are linked; component_id is the smallest doc_id reachable
    over links, and exactly one row per component, the smallest, is kept. Null and empty texts have fingerprint 0 and are
    linked like any other. Null doc_ids sort after all others. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = scratch.write(rows.groupBy("fp").agg(first.alias("first")))
    edges = scratch.write(links(distinct.select("fp"), scratch, radius).distinct())
    labels = components(edges, scratch)
    own = scratch.write(distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first"))
    best = scratch.write(own.groupBy("label").agg(F.min("first").alias("best")))
    where = scratch.write(own.join(best.hint("merge"), "label").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row")))
    return rows.join(where.hint("merge"), "fp").select("doc_id", "fp", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"), "text_hash")


def _from_here_on(text: np.ndarray, key: np.ndarray, df: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences of shingles (text, key, df, place), the first of each shingle of a text, and how many words of the text stand in that shingle or in ones that come after it by (df, key)."""
    order = np.lexsort((key, df))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (df[order][1:] != df[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    back = len(order) + 1 - rank  # small for shingles that come late
    words = (text[:, None], at[:, None] + np.arange(width), back[:, None])
    t, w, b = (np.broadcast_to(x, (len(text), width)).reshape(-1) for x in words)
    order = np.lexsort((b, w, t))
    t, w, b = t[order], w[order], b[order]
    one = np.ones(len(t), bool)
    one[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    span = len(text) + 2
    latest = np.sort(t[one] * span + b[one])  # per word, the last of the shingles that it stands in
    mine, first = np.unique(text * span + back, return_index=True)
    return first, np.searchsorted(latest, mine, side="right") - np.searchsorted(latest, text[first] * span)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of batches of integers sorted by the first column, in arrays that do not part rows of one value of it."""
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        rows += len(batch)
        if rows >= OCCURRENCES_AT_ONCE:
            x = np.concatenate(held)
            last = np.flatnonzero(x[1:, 0] != x[:-1, 0])
            held, rows = [x], 0
            if len(last):
                yield x[: last[-1] + 1]
                held, rows = [x[last[-1] + 1 :]], len(x) - int(last[-1]) - 1
    x = np.concatenate(held) if held else np.zeros((0, 0), np.int64)
    if len(x):
        yield x


def _pairs(key: np.ndarray, ident: np.ndarray, label: np.ndarray, prev: np.ndarray, spare: np.ndarray, hubs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows of one key and two labels whose spares add up to zero at least; with hubs, only of the largest spare of a key with the largest of each other label.

    Rows that have the previous key in common are passed over: they are a pair there, or at a key before it.
    """
    if not len(key):
        return
    rows = np.lexsort((ident, -spare, key))
    new = np.append(True, key[rows][1:] != key[rows][:-1])
    most = spare[rows][new][np.cumsum(new) - 1]
    rows = rows[spare[rows] + most > -1e-6]
    for group in np.split(rows, np.flatnonzero(np.diff(key[rows])) + 1) if len(rows) else []:
        of, before, has = label[group], prev[group], spare[group]
        if (of == of[0]).all():
            continue
        if hubs:
            first = np.unique(of, return_index=True)[1]
            first = first[first > 0]
            yield np.full(len(first), group[0]), group[first]
            continue
        for k in range(int((has > -1e-6).sum())):
            reach = int(np.searchsorted(-has, has[k] + 1e-6))  # spares descend
            other = np.arange(k + 1, reach)
            other = other[(of[other] != of[k]) & ((before[other] != before[k]) | (before[k] < 0))]
            if len(other):
                yield np.full(len(other), group[k]), group[other]


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch, check: Check, chunk: int) -> DataFrame:
    """Of pairs (a, b, la, lb) of nodes in two components, links that connect the same components as all links do. Each a meets chunks of its b."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / chunk)
    dealt = scratch.write(pairs.withColumn("part", numbered))
    heads = dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("id"), F.col("la").alias("label")).distinct()
    rows = scratch.write(heads.union(dealt.select("a", "part", F.lit(1), "b", "lb")))
    members = rows.select("id").distinct().join(nodes.select("id", "fp", "text_hash").hint("merge"), "id")
    members = scratch.write(members.select("id", "fp", "text_hash", F.lit(0).alias("shard"), F.lit(0).alias("sig")))
    hashes = scratch.write(_with_hashes(docs, members, check.shingle, check.measure).select("id", "hashes"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, joined, distinct = None, set(), {}
        for batch in batches:
            out = []
            for a, _, role, b, label, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(h, np.uint64)
                if not role:
                    head, joined, distinct = h, {label}, {}
                    continue
                if label in joined:
                    continue
                distinct.pop(1, None)
                if check.holds([head, h], distinct, 0, 1):
                    joined.add(label)
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    whole = rows.join(hashes.hint("merge"), "id").select("a", "part", "role", "id", "label", "hashes")
    whole = whole.repartition(partitions, "a", "part").sortWithinPartitions("a", "part", "role", "id")
    return scratch.write(whole.mapInArrow(compare, "a long, b long"))


def _missed(docs: DataFrame, nodes: DataFrame, scratch: Scratch, shingle: int, similarity: float, measure: str, chunk: int) -> DataFrame:
    """Edges (a, b) that connect exactly the linked rows of nodes (id, fp, text_hash, n, label) that lie in different components (label)."""
    width = shingle if measure == "covered" else 1
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(partitions, total // BUCKET + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def dealt(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(h) for _, _, h in held]
            h = np.concatenate([h for _, _, h in held])
            at = np.concatenate([np.arange(n) for n in sizes])
            owner = np.repeat(np.arange(len(held)), sizes)
            ids, apart = np.array([i for i, _, _ in held], np.int64), np.array([i - label for i, label, _ in held], np.int64)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                texts, counts = np.unique(owner[part], return_counts=True)
                narrow = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in (counts, at[part])]
                out.append((int(bucket[part[0]]), ids[texts].tobytes(), apart[texts].tobytes(), narrow[0], (h[part] >> np.uint64(32)).astype("<u4").tobytes(), narrow[1]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out, strict=True))], names=["bucket", "ids", "apart", "counts", "keys", "at"])

        held, size = [], 0
        for batch in batches:
            for i, label, text in zip(*batch.columns, strict=True):
                i = i.as_py()
                if i in seen:
                    continue
                seen.add(i)
                h = shingle_hashes(text.as_py(), shingle)
                held.append((i, label.as_py(), h if measure == "covered" else np.unique(h)))
                size += len(held[-1][2])
                if size >= OCCURRENCES_AT_ONCE:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(x: bytes, n: int) -> np.ndarray:
            return np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64)

        def several(bucket: int, held: list[tuple]) -> pa.RecordBatch:
            rows = []
            for ids, apart, counts, keys, at in held:
                ids, apart, keys = np.frombuffer(ids, np.int64), np.frombuffer(apart, np.int64), np.frombuffer(keys, "<u4")
                n = read(counts, len(ids))
                rows.append((keys, np.repeat(ids, n), np.repeat(ids - apart, n), read(at, len(keys))))
            key, ids, labels, at = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((ids, key))
            key, ids, labels, at = key[order].astype(np.int64), ids[order], labels[order], at[order]
            first = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            n = np.diff(np.append(first, len(key)))
            df = np.add.reduceat(np.append(True, (np.diff(key) != 0) | (np.diff(ids) != 0)).astype(np.int64), first)  # texts: one that repeats a shingle does not make it frequent
            kept = np.repeat(np.minimum.reduceat(labels, first) < np.maximum.reduceat(labels, first), n)
            columns = (key | bucket << 32, ids, labels, at, np.repeat(df, n))
            return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], names=["key", "id", "label", "at", "df"])

        now, held = -1, []
        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield several(now, held)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield several(now, held)

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = texts.join(nodes.select("text_hash", "id", "label").hint("merge"), "text_hash").select("id", "label", "text")
    spread = held.mapInArrow(deal, "bucket long, ids binary, apart binary, counts binary, keys binary, at binary")
    shared = scratch.write(spread.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(share, "key long, id long, label long, at long, df long"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole(batches):
            text = np.cumsum(np.concatenate(([0], x[1:, 0] != x[:-1, 0])))
            first, have = _from_here_on(text, x[:, 2], x[:, 4], x[:, 3], width)
            text, x = text[first], x[first]
            order = np.lexsort((x[:, 2], x[:, 4], text))
            prev = np.full(len(x), -1)
            prev[order[1:]] = np.where(text[order[1:]] == text[order[:-1]], x[order[:-1], 2], -1)
            spare = have - similarity * (x[:, 5] + shingle - 1) if measure == "covered" else have * (1 + similarity) / 2 - similarity * x[:, 5]
            columns = (x[:, 2], x[:, 0], x[:, 1], prev, x[:, 5], spare.astype(np.float64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "label", "prev", "n", "spare"])

    columns = ("id", "label", "key", "at", "df", "n")
    dealt = shared.join(nodes.select("id", "n"), "id").select(*columns).repartition(partitions, "id").sortWithinPartitions("id")
    weights = scratch.write(dealt.mapInArrow(weigh, "key long, id long, label long, prev long, n long, spare long"))
    scratch.drop(shared)
    check = Check(measure, 0.0, similarity, shingle)

    def links_of(weights: DataFrame, hubs: bool) -> DataFrame:
        """Links between components; a is the longer text of a pair."""

        def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: list[np.ndarray]) -> pa.RecordBatch:
                x = np.unique(np.concatenate(held), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], names=["a", "b", "la", "lb"])

            for x in _whole(batches):
                held, size = [], 0
                for i, j in _pairs(x[:, 0], x[:, 1], x[:, 2], x[:, 3], np.ascontiguousarray(x[:, 5]).view(np.float64), hubs):
                    longer = (x[i, 4] > x[j, 4]) | ((x[i, 4] == x[j, 4]) & (x[i, 1] > x[j, 1]))
                    i, j = np.where(longer, i, j), np.where(longer, j, i)
                    held.append(np.stack([x[i, 1], x[j, 1], x[i, 2], x[j, 2]], axis=1))
                    size += len(i)
                    if size >= PAIRS_AT_ONCE:
                        yield out(held)
                        held, size = [], 0
                if size:
                    yield out(held)

        sorted_ = weights.select("key", "id", "label", "prev", "n", "spare").repartition(partitions, "key").sortWithinPartitions("key")
        pairs = scratch.write(sorted_.mapInArrow(pair, "a long, b long, la long, lb long").distinct())
        return pairs if pairs.isEmpty() else _compared(docs, nodes, pairs, scratch, check, chunk)

    found = links_of(weights, True).select("a", "b")
    if not found.isEmpty():
        at = nodes.select("id", "label")
        ends = scratch.write(found.join(at.withColumnRenamed("id", "a").withColumnRenamed("label", "la"), "a").join(at.withColumnRenamed("id", "b").withColumnRenamed("label", "lb"), "b"))
        joined = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch).select(F.col("node").alias("label"), F.col("label").alias("to"))
        weights = scratch.write(weights.join(joined.hint("merge"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
    return scratch.write(found.union(links_of(weights, False).select("a", "b")).distinct())


def near_components(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, radius: int = 64, chunk: int = CHUNK, measure: str = "jaccard") -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, component_id, kept, text_hash.

    Texts are linked that have at least the similarity, exactly: by the Jaccard similarity of their sets of word shingles, or
    by measure "covered" (above). Two texts are compared if they share a band (BANDS) and, for "jaccard", the estimate from
    PERMUTATIONS min-hashes falls short by no more than MARGIN; for "covered", that or COVERED_SHARE in COVERED_PARTS of both
    texts. An exact search then finds the links between components that these comparisons missed. component_id is the smallest doc_id reachable over links, and exactly one row per component, the smallest, is
    kept. Null and empty texts are one component. Null doc_ids sort after all others; rows that repeat are one component.
    Further columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.write(sketches(docs, shingle, measure))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = scratch.write(rows.groupBy("fp", "whole").agg(first.alias("first"), F.min("row").alias("id"), *[F.first(x).alias(x) for x in ("sig", "bands", "n")]))
    bands = scratch.write(nodes.select("id", F.posexplode("bands").alias("k", "v")).select("id", F.xxhash64("k", "v").alias("shard")))
    shared = scratch.write(bands.groupBy("shard").count().filter("count > 1").select("shard"))
    cells = scratch.write(bands.join(shared.hint("merge"), "shard").select("id", "shard"))
    scratch.drop(bands, shared)
    cells = scratch.write(cells.join(nodes.select("id", "fp", "sig").hint("merge"), "id"))
    near = scratch.write(_search(cells, scratch, radius, chunk, Check(measure, similarity - MARGIN)).distinct())
    scratch.drop(cells)
    clusters = scratch.write(components(near, scratch).select(F.col("node").alias("id"), F.col("label").alias("shard")))
    members = scratch.write(clusters.join(nodes.select("id", "fp", "sig").hint("merge"), "id").join(rows.select(F.col("row").alias("id"), "text_hash").hint("merge"), "id"))
    cells = scratch.write(_with_hashes(docs, members, shingle, measure))
    edges = scratch.write(_search(cells, scratch, 64, chunk, Check(measure, similarity - MARGIN, similarity, shingle)).distinct())
    scratch.drop(cells, members)
    labels = components(edges, scratch).select(F.col("node").alias("id"), "label")
    own = scratch.write(nodes.join(labels, "id", "left").join(rows.select(F.col("row").alias("id"), "text_hash").hint("merge"), "id").select("id", "fp", "whole", "text_hash", "n", F.coalesce("label", "id").alias("label"), "first"))
    missed = _missed(docs, own, scratch, shingle, similarity, measure, chunk)
    if not missed.isEmpty():
        labels = components(edges.union(missed), scratch).select(F.col("node").alias("id"), F.col("label").alias("found"))
        own = scratch.write(own.join(labels, "id", "left").select("fp", "whole", F.coalesce("found", "id").alias("label"), "first"))
    best = scratch.write(own.groupBy("label").agg(F.min("first").alias("best")))
    where = scratch.write(own.join(best.hint("merge"), "label").select("fp", "whole", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row")))
    return rows.join(where.hint("merge"), ["fp", "whole"]).select("doc_id", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"), "text_hash")
