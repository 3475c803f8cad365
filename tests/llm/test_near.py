"""Near copies by covered words: against brute force over all pairs, and on what they must leave alone."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from terrapix.llm import simhash

SF = "/root/testdata/sf0.01"


def _slow(a, b):
    """Covered words by the definition, on word lists."""
    has = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    both = has(a) & has(b)
    total = 0
    for ws in (a, b):
        total += len({k + d for k in range(len(ws) - 4) if tuple(ws[k : k + 5]) in both for d in range(5)})
    return total / (len(a) + len(b))


def _roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_covered_words():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        b = [w if rng.random() < 0.9 else rng.choice("abcdefgh") for w in a][: rng.randint(5, 60)]
        got = simhash.covered(simhash.shingle_hashes(" ".join(a), 5), simhash.shingle_hashes(" ".join(b), 5), 5)
        assert abs(got - _slow(a, b)) < 1e-12
    none = np.zeros(0, np.uint64)
    assert simhash.covered(none, none, 5) == 1 and simhash.covered(none, simhash.shingle_hashes("a b", 5), 5) == 0


def test_recall_against_all_pairs(spark, duck):
    docs = [(i, t or "") for i, t in duck.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]
    seqs = [simhash.shingle_hashes(t, 5) for _, t in docs]
    sets = [np.unique(s) for s in seqs]
    holders = {}
    for k, h in enumerate(sets):
        for x in h.tolist():
            holders.setdefault(x, []).append(k)
    shared = Counter(pair for own in holders.values() for pair in combinations(own, 2))
    links = [(j, i) for (i, j), n in shared.items() if simhash.covered(seqs[i], seqs[j], 5, (sets[i], sets[j])) >= 0.8]
    links += [(i, j) for i in range(len(docs)) for j in range(i) if not len(seqs[i]) and not len(seqs[j])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.read.parquet(f"{SF}/documents.parquet"), measure="covered").collect()}
    unlike = [(i, j) for i, j in links if docs[i][1].split() != docs[j][1].split()]
    found = sum(got[docs[i][0]] == got[docs[j][0]] for i, j in unlike)
    assert len(unlike) > 50 and found >= 0.95 * len(unlike)
    truth = _roots(len(docs), links)
    for (i, _), root in zip(docs, truth, strict=True):
        assert got[got[i]] == got[i] and truth[[d for d, _ in docs].index(got[i])] == root


def test_copies_are_found_and_shared_passages_left_alone(spark):
    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    passage, texts = say(70), []
    for g in range(60):
        base = say(rng.randint(120, 400))
        texts.append(base)
        texts.append([w if rng.random() < 0.93 else f"x{g}" for w in base])
    for _ in range(120):
        own = say(rng.randint(60, 130))
        k = rng.randrange(len(own))
        texts.append(own[:k] + passage + own[k:])
    for chunk in (16, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), chunk=chunk, measure="covered").collect()}
        assert all(got[k] == k for k in range(120, 240))
        near = [_slow(texts[k], texts[k + 1]) >= 0.8 for k in range(0, 120, 2)]
        assert sum(near) > 50 and sum((got[2 * k + 1] == 2 * k) == x for k, x in enumerate(near)) >= 59
        assert all(x or got[2 * k + 1] == 2 * k + 1 for k, x in enumerate(near))


def test_texts_that_repeat_a_line(spark):
    rng = random.Random(8)
    texts = []
    for few, many, words, line in ((1, 20, 200, 12), (2, 60, 300, 15)) * 10:
        w, x = ([f"w{rng.randrange(50_000)}" for _ in range(n)] for n in (words, line))
        texts += [" ".join(w + x * n) for n in (few, many)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), measure="covered").collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "A  b"), (5, "a b c d e f g"), (6, "x " * 30_000), (7, "x " * 29_000)], "doc_id long, text string").withColumn("sig", F.lit("s")).withColumn("row", F.lit(1))
    got = simhash.near_components(df, measure="covered").collect()
    assert len(got) == 9 and sum(r["kept"] for r in got) == 4
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 6), (7, 6)]
    assert simhash.near_components(df.limit(0), measure="covered").count() == 0


def test_no_link_is_lost_that_min_hashes_miss(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    texts = []
    for g in range(12):
        for n in (11, 14, 18, 30):  # too short for min-hashes in eleven sixteenths
            a = say(n)
            texts += [a, [*a[: n // 2], f"x{g}", *a[n // 2 + 1 :]]]
        for gap in (5, 6, 8):  # changes all over: one shingle in six is shared, or none
            a = say(240)
            texts += [a, [f"x{k}" if k % gap == gap - 1 else w for k, w in enumerate(a)]]
        a, b = say(34), say(470)  # one holds a passage of the other many times over
        texts += [a * 60, b[:200] + a + b[200:]]
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    for chunk in (16, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(frame, chunk=chunk, measure="covered").collect()}
        linked = [_slow(texts[k], texts[k + 1]) >= 0.8 for k in range(0, len(texts), 2)]
        assert sum(linked) == 12 * 7 and got == {k: k - (k % 2 if linked[k // 2] else 0) for k in range(len(texts))}


def test_words_from_a_shingle_on():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 60))
        text, key, at = np.sort(rng.integers(0, 4, n)), rng.integers(0, 12, n), rng.permutation(n)
        df = rng.integers(2, 5, 12)[key]
        for width in (1, 5):
            first, have = simhash._from_here_on(text, key, df, at, width)
            assert {(text[f], key[f]) for f in first} == set(zip(text, key, strict=True)) and len(first) == len({*zip(text, key, strict=True)})
            for f, words in zip(first, have, strict=True):
                assert words == len({at[k] + d for k in range(n) if text[k] == text[f] and (df[k], key[k]) >= (df[f], key[f]) for d in range(width)})


def test_a_shared_line_compares_no_whole_cluster(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    line, looked = say(9), []
    texts = [[*say(60), *line, *say(40)] for _ in range(300)]
    for _ in range(4):  # all but the line is a pair of words over and over
        texts.append([*line, *["on", "off"] * 250])
    search = simhash._search

    def searched(cells, *more):
        if "hashes" in cells.columns:
            looked.append(sum(r["count"] * (r["count"] - 1) // 2 for r in cells.groupBy("shard").count().collect()))
        return search(cells, *more)

    monkeypatch.setattr(simhash, "_search", searched)
    if hasattr(simhash, "_compared"):
        compare = simhash._compared
        monkeypatch.setattr(simhash, "_compared", lambda docs, nodes, pairs, *more: (looked.append(pairs.count()), compare(docs, nodes, pairs, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), measure="covered").collect()}
    assert got == {k: min(k, 300) for k in range(len(texts))}
    assert sum(looked) <= 2 * len(texts)


def test_pairs_are_those_that_suffice_at_a_shingle():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n = int(rng.integers(0, 40))
        key, ident = rng.integers(0, 5, n), np.arange(n)
        label, spare = rng.integers(0, 4, n), rng.integers(-5, 4, n).astype(float)
        alone = np.full(n, -1)
        want = {(i, j) for i, j in combinations(range(n), 2) if key[i] == key[j] and label[i] != label[j] and spare[i] + spare[j] >= 0}
        got = [tuple(sorted(p)) for a, b in simhash._pairs(key, ident, label, alone, spare, False) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        assert {tuple(sorted(p)) for a, b in simhash._pairs(key, ident, label, alone, spare, True) for p in zip(a.tolist(), b.tolist(), strict=True)} <= want
        assert not list(simhash._pairs(key, ident, label, np.full(n, 7), spare, False))
