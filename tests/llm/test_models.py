"""The three classifiers against plain versions of what they compute, one gram, word or sentence at a time."""

import math
import random
import re

import numpy as np
import pytest

from terrapix.llm import langid, ngrams, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(duck):
    return [t or "" for t, in duck.execute(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]


def _hash(gram):
    """The n-gram hash, in integers."""
    m = 2**64 - 1
    h = (gram[0] + (len(gram) << 32)) & m
    for x in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + x) & m
    h ^= h >> 31
    h = h * 0xFF51AFD7ED558CCD & m
    return h ^ (h >> 29)


def test_language_counts_and_decision(texts):
    rng = random.Random(1)
    own = {f"l{k}": {tuple(map(ord, t[i : i + n])) for t in texts[k::3] for n in (2, 3, 4) for i in rng.sample(range(max(len(t) - n, 1)), min(200, max(len(t) - n, 1))) if len(t[i : i + n]) == n} for k in range(3)}
    members = {name: np.array([_hash(g) for g in grams], np.uint64) for name, grams in own.items()}
    f = langid.LanguageFilter(members, slot_bits=16)
    slots = {(k, _hash(g) >> p * 16 & 0xFFFF) for k, name in enumerate(f.languages) for g in own[name] for p in range(3)}
    for t in [*texts[:25], "", "a", "1 2 3", "Ünïcode ß 日本"]:
        points = [ord(c) if c.isalpha() else 32 for c in t.lower()]
        n, found = 0, [0] * 3
        for size in (2, 3, 4):
            for i in range(len(points) - size + 1):
                h = _hash(points[i : i + size])
                n += 1
                for k in range(3):
                    found[k] += all((k, h >> p * 16 & 0xFFFF) in slots for p in range(3))
        rate = [(sum(j == k for j, _ in slots) / 65536) ** 3 for k in range(3)]
        want = [max(x - n * r, 0) / (1 - r) for x, r in zip(found, rate, strict=True)]
        got, total = f.counts(t)
        assert total == n and np.allclose(got, want)
        name, score = f.predict(t)
        if not any(map(str.isalpha, t)):
            assert (name, score) == ("und", 0.0)
        else:
            best = max(range(3), key=lambda k: (want[k], -k))
            assert name == f.languages[best] and score == pytest.approx(want[best] / sum(want) if sum(want) else 0.0)


def test_gram_hashes():
    for s in ("", "a", "abc", "日本語 text", "😀😀"):
        for n in (1, 2, 3):
            points = list(map(ord, s))
            assert ngrams.hashes(ngrams.codepoints(s), n).tolist() == [_hash(points[i : i + n]) for i in range(len(points) - n + 1)]


def _shape(t):
    out = []
    for c in t:
        k = 97 if c.isalpha() and c.lower() == c else 65 if c.isalpha() else 57 if c.isdigit() else (10 if c == "\n" else 32) if c.isspace() else ord(c)
        if not out or out[-1] != k:
            out.append(k)
    return out


def test_quality_scores(texts):
    rng = random.Random(2)
    labels = [rng.randrange(2) for _ in texts]
    model = quality.QualityModel(texts, labels)
    seen = np.zeros(1 << quality.FEATURE_BITS, bool)
    ids = []
    for t in texts[:40]:
        symbols = [(list(map(ord, t)), quality.SIZES), (_shape(t), quality.SHAPE_SIZES)]
        ids.append(sorted({_hash(s[i : i + n]) >> 64 - quality.FEATURE_BITS for s, sizes in symbols for n in sizes for i in range(len(s) - n + 1)}))
        assert quality.indicators(t, seen).tolist() == ids[-1]
    fit = [k for k in range(len(texts)) if k % 5 != 4]
    every = [set(quality.indicators(t, seen).tolist()) for t in texts]
    count = lambda label, i: 1 + sum(i in every[k] for k in fit if labels[k] == label)
    total = [sum(len(every[k]) for k in fit if labels[k] == label) + (1 << quality.FEATURE_BITS) for label in (0, 1)]
    for i in rng.sample(sorted(set().union(*every)), 60):
        assert model.ratio[i] == pytest.approx(math.log(count(1, i) / total[1]) - math.log(count(0, i) / total[0]))
    for t, own in zip(texts[:40], ids, strict=True):
        norm = math.sqrt(sum(model.ratio[i] ** 2 for i in own)) or 1.0
        z = model.slope * (sum(model.weight[i] for i in own) / norm + model.bias) + model.shift
        assert model.score(t, seen) == pytest.approx(1 / (1 + math.exp(-max(min(z, 30), -30))))


def test_dual_solution_is_optimal():
    """No step along any coordinate of the dual lowers its objective."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w = quality.dual_coordinate_descent([(np.arange(4), r) for r in x], y, 4, np.ones(60), 3000)
    primal = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(primal(w) <= primal(w + step) + 1e-2 for step in rng.normal(size=(300, 4)) * 0.05)


def test_toxicity_scores_and_places(texts):
    rng = random.Random(4)
    words = sorted({w for t in texts[:60] for w in re.findall(r"[^\W\d_]+", t.lower())})
    model = toxicity.ToxicityModel([], [])
    model.bias, model.weights = -4.0, {x: rng.uniform(-2, 3) for w in rng.sample(words, min(300, len(words))) for x in toxicity.features(w)}
    sums = model.sums()
    for t in [*texts[:60], "", "...", "one"]:
        none, places = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", t):
            ws = re.findall(r"[^\W\d_]+", m[0].lower())
            if ws:
                z = model.bias + sum(model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "-", 0) for k in (3, 4, 5, 6) if len(w) >= k) for w in ws)
                p = 1 / (1 + math.exp(-max(min(z, 30), -30)))
                none *= 1 - p
                places.append((m.start(), m.end(), p))
        assert model.score(t, sums) == pytest.approx(1 - none if places else 0.0, abs=1e-9)
        want = [x for x in places if x[2] >= 0.5] or sorted(places, key=lambda x: -x[2])[:1]
        assert [(a, b) for a, b, _ in model.offending(t, sums)] == [(a, b) for a, b, _ in want]
