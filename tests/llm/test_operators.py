"""Each operator against brute force or its contract, and on odd tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF, rows
from pyspark.sql import functions as F

import corpus_pipeline
from terrapix.llm import decontam, html_text, langid, license_scan, packing, pii, quality, queries, simhash, toxicity
from terrapix.llm.common import Scratch, fold
from terrapix.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word another thing. " * 3000
    data = [(1, None), (2, ""), (3, "  \t\n "), (4, "same  text\there"), (5, "same text here"), (5, "same text here"), (None, "no id here"), (None, None), (6, long), (7, long), (8, "x"), (9, "naïve Ünïcode ß 日本語 😀 text"), (10, "Licensed under CC BY-NC 4.0. All rights reserved.")]
    return spark.createDataFrame([(i, t, None, "s", None, 7, "n", 0.5) for i, t in data], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents ORDER BY 1").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF)) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


# 1


def test_license(spark, odd, none):
    got = license_scan.license_scan(odd).collect()
    assert len(got) == odd.count()
    ten = next(r for r in got if r["doc_id"] == 10)
    assert (ten["n_words"], ten["n_base"], ten["first_word"], ten["last_word"], ten["base_labels"], ten["labels"], ten["score"]) == (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0)
    empty = next(r for r in got if r["doc_id"] == 2)
    assert (empty["n_words"], empty["first_word"], empty["labels"], empty["score"]) == (0, None, "", 0.0)
    assert license_scan.license_scan(none).count() == 0


def test_license_templates_of_any_length(spark):
    rng = random.Random(6)
    temps = [(f"t{n}", " ".join(f"w{rng.randrange(400)}" for _ in range(n))) for n in (5, 24, 25, 48, 49, 170, 700)]
    texts = ["", *(" ".join([*(f"v{k}" for k in range(rng.randint(0, 90))), t, *(f"u{k}" for k in range(50))]) for _, t in temps)]
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), temps).collect()}
    assert all(name in got[k + 1] for k, (name, _) in enumerate(temps)) and got[0] == [""]


def test_license_filters_lose_nothing(spark):
    rng = random.Random(1)
    temps = [(f"t{k}", " ".join(rng.sample("abcdefghijklmnopqrst", rng.randint(3, 9)))) for k in range(12)]
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 120))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], m["t"], m["at"]) for r in license_scan.license_scan(df, temps, 0.7, 24, 12).collect() for m in r["matches"]}
    want = set()
    for d, t in enumerate(texts):
        ws = t.split()
        for at in range(0, len(ws), 12):
            for k, (_, x) in enumerate(temps):
                if len(set(x.split()) & set(ws[at : at + 24])) >= 0.7 * len(set(x.split())) - 1e-9:
                    want.add((d, k, at))
    assert got == want and want


# 2


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.choice([10, 50, 64])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 250))]
        histogram = defaultdict(int)
        for x in lengths:
            histogram[x] += 1
        bins = defaultdict(list)
        for length, _, items, first, per, at in packing.best_fit_plan(histogram, size).tolist():
            for i in range(items):
                bins[first + i // per].append((at + i % per * length, length))
        for b in bins.values():
            end = 0
            for at, length in sorted(b):
                assert at == end
                end += length
            assert end <= size
        open_ = []
        for x in sorted(lengths, reverse=True):
            fit = [(room, k) for k, room in enumerate(open_) if room >= x]
            if fit:
                open_[min(fit)[1]] -= x
            else:
                open_.append(size - x)
        assert len(bins) == len(open_) and sum(map(len, bins.values())) == len(lengths)


def test_packing(spark, odd, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(queries.TOKENIZER))
    pieces = packing.tokenized_pieces(odd, queries.TOKENIZER, 512)
    want = []
    for r in odd.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512)]
    got = packing.packed(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), 512).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"])) for r in got)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for at, length in sorted(p):
            assert at == end
            end += length
        assert end <= 512
    assert packing.packed(packing.tokenized_pieces(none, queries.TOKENIZER).drop("ids")).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    names = ["_row", "_own", "_salt", "_rank", "_before", "_at", "piece", "count", "sequence_id", "offset", "a.b", "_"]
    df = spark.createDataFrame([(5, *[f"{n}{k}" for n in names]) for k in range(3)] * 2, ["length", *names]).withColumn("length", F.col("length").cast("long"))
    got = packing.packed(df, 16)
    assert got.columns == ["length", *[n for n in names if n not in ("sequence_id", "offset")], "sequence_id", "offset"]
    assert sorted(r["_own"] for r in got.collect()) == ["_own0", "_own0", "_own1", "_own1", "_own2", "_own2"]
    assert sorted((r["sequence_id"], r["offset"]) for r in got.collect()) == [(0, 0), (0, 5), (0, 10), (1, 0), (1, 5), (1, 10)]


def test_word_encoder_equals_tokenizer():
    from public_tokenizers import path

    e = packing.WordEncoder(path(queries.TOKENIZER))
    for s in ["", "  ", "don't WON'T 'sx it's<|endoftext|>", "Ünïcode ß ſ ǅ ª²³½ … ΣΑΣ İ", "a b\x1cc \x85 d", "日本 é é", "!!'s !'s ''ve", "x" * 5000]:
        assert e.encode(s) == np.array(e.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


# 3, 4, 6


def test_language_filter():
    grams = {f"l{k:02d}": np.random.default_rng(k).integers(0, 2**63, 500).astype(np.uint64) for k in range(70)}
    f = langid.LanguageFilter(grams, 14, 3)
    for k, name in enumerate(f.languages):
        assert (f.languages_of(grams[name])[k // 64] & np.uint64(1 << k % 64) != 0).all()
    other = np.random.default_rng(99).integers(0, 2**63, 20000).astype(np.uint64)
    found = np.mean((f.languages_of(other)[0] & np.uint64(1)) != 0)
    assert abs(found - f.false_positive[0]) < 0.01


def test_language(spark, docs, odd, none):
    got = queries.op3_language_id(spark, SF).toPandas()
    lang = {i: x for i, _, x in docs}
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == "und" and out[8] != "und"
    nothing = langid.fit(none)
    assert nothing.predict("text") == ("und", 0.0) and langid.identify(none, model).count() == 0


@pytest.mark.parametrize(("name", "label", "n", "held"), [("op4_quality", "quality", 3, 1), ("op6_toxicity", "toxic", 5, 0)])
def test_classifiers(spark, duck, name, label, n, held):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, sf).toPandas()
    truth = dict(duck.execute(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    assert (got.held_out == [zlib.crc32(str(i).encode()) % n == held for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    out = got[got.held_out & got.doc_id.isin(truth)]
    assert (out.predicted == out.doc_id.map(truth)).mean() > 0.85


def test_models_on_odd_rows(odd, none):
    for model in (quality.QualityModel([], []), quality.QualityModel(["a", "b"], [1, 1])):
        assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())
    assert quality.fit(none, none.select("doc_id", F.lit(1).alias("label"))).score("x", np.zeros(1 << quality.FEATURE_BITS, bool)) == 0.5
    model = toxicity.ToxicityModel(["fine text. nice words"] * 20 + ["fine text. you idiot"] * 20, [0] * 20 + [1] * 20)
    sums = toxicity.WordSums(model.weights)
    assert model.score("nice words. what an idiot. fine", sums) > 0.5 > model.score("nice words. fine text", sums)
    assert [("idiot" in "nice words. what an idiot. fine"[a:b]) for a, b, _ in model.offending("nice words. what an idiot. fine", sums)] == [True]
    got = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    assert got[1]["score"] == got[2]["score"] == 0.0 and toxicity.score(none, model).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 3] > 0, 1.0, -1.0)
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.full(200, 10.0), 200)
    assert (np.sign(x @ w) == y).mean() > 0.97


# 5


def test_exact(odd, none, docs, spark):
    got = exact_dedup(odd, 16).collect()
    assert len(got) == odd.count()
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for r in odd.collect():
        groups[norm(r["text"])].append(r["doc_id"])
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert (r["keep_id"], r["group_size"]) == (min(ids) if ids else None, len(groups[text]))
    assert sum(r["kept"] for r in got) == len(groups) and exact_dedup(none).count() == 0
    small = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup(small, 64).collect()} == {(r["doc_id"], r["keep_id"]) for r in exact_dedup(small).collect()}


def test_identities_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for parts in (1, 7):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        seen.append(sorted((r["doc_id"], r["n_blocks"], r["identity"]) for r in exact_dedup(df.repartition(parts), 8).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


# 7


def test_texts_that_share_an_item_id(spark):
    a = "what is the name of the tall green house here? it is the old town hall of stones"
    b = "which of these seven rivers runs to the north? the one that has no bridge at all"
    bench = spark.createDataFrame([(1, a), (1, b), (2, b), (2, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, b), (2, b), (3, a + " and " + b), (4, None)], "doc_id long, text string").withColumn("leaks", F.lit("old"))
    for chars in (10, 1000):
        got = decontam.find_leaks(docs, bench, max_index_chars=chars)
        assert got.columns == docs.columns
        assert sorted((r["doc_id"], [x["item_id"] for x in r["leaks"]]) for r in got.collect()) == [(1, [1]), (2, [1, 2]), (2, [1, 2]), (3, [1, 2]), (4, [])]
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_wand_returns_all_above_threshold(docs, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    for block in (2, 64):
        decontam.BLOCK = block
        index = decontam.Index(items)
        found = 0
        for _, text, _ in docs[:60]:
            terms = sorted({index.ids[w] for w in decontam.words(text)[:80] if w in index.ids})
            for index.threshold in (0.6, 0.15, 0.05):
                sums = defaultdict(float)
                for t in terms:
                    for s, x in zip(index.at_lists[t], index.impact_lists[t], strict=True):
                        sums[s] += x
                want = {s for s, x in sums.items() if x >= index.threshold - 1e-9}
                assert {s for s, _ in index.search(terms)} == want
                found += len(want)
        assert found
    decontam.BLOCK = 64


def test_leaks(spark, docs, duck, odd, none):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    parts = {i: decontam.shingles(decontam.words(t)) for i, t in items}
    want = set()
    for d, text, _ in docs:
        have = decontam.shingles(decontam.words(text))
        want |= {(d, i) for i, s in parts.items() if len(s & have) >= 0.8 * len(s)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_benchmark_decontamination(spark, SF).collect()}
    assert got == want and want
    bench = spark.createDataFrame([(1, "What is the capital of the small country here? It is the old town of stones"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "so: what is the capital of the small country here? it is the old town of stones!"), (2, "what is the capital of the small country here? nobody knows at all today"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: len(r["leaks"]) for r in decontam.find_leaks(asked, bench).collect()}
    assert found == {1: 1, 2: 0, 3: 0}
    assert {r["doc_id"]: len(r["leaks"]) for r in decontam.find_leaks(asked, bench, max_index_chars=10).collect()} == found
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).count() == odd.count()


def test_leaks_with_question_and_answer_apart(duck):
    items = duck.execute("SELECT item_id, text FROM '/root/testdata/sf0.1/benchmark.parquet' WHERE item_id IS NOT NULL").fetchall()
    index = decontam.Index(items)
    between = " ".join(f"filler{k}" for k in range(200))
    apart = {i: (q, a) for i, (q, a) in index.items.items() if q and a}
    assert len(apart) > 100
    for i, (q, a) in apart.items():
        assert i in {x["item_id"] for x in index.leaks(" ".join([*q, between, *a]))}
        assert i in {x["item_id"] for x in index.leaks(" ".join([*a, between, *q]))}


# 8


def test_pages(spark, duck):
    got = {r["page_id"]: r for r in queries.op8_html_extraction(spark, SF).collect()}
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, page in pages:
        article = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|li|ul)[^>]*>", " ", re.search("<article>(.*)</article>", page, re.S)[1]))
        assert got[i]["text"] == " ".join(html.unescape(article).split())
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_page_parts():
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav>a</nav>
<div class="wrap"><div class="post-content"><h2>Title &amp; more</h2><p>First para with <a href=x>link</a> text that is long enough.</p><!-- c --><p>Second<br>para is here, quite long too and more.</p>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><script>var x = "</p>";</script><form><input><button>go</button></form></div><aside>side</aside><section class="comments"><p>nice post I like this very much indeed</p></section></div><footer>f</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First para with link text that is long enough. Second para is here, quite long too and more. one two a b"
    assert [html_text.main_text(x) for x in (None, "", "plain text", "<p>a<p>b", "<", "<div", "a < b & c")] == ["", "", "plain text", "a b", "<", "<div", "a < b & c"]
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"


def test_density_decides_beside_article_and_main():
    say = lambda k: " ".join(f"Part {k} tells of word{k}x{j} and goes on at some length about it." for j in range(12))
    parts = "".join(f"<article><h2>Title {k}</h2><p>{say(k)}</p><p>{say(k + 10)}</p></article>" for k in range(3))
    want = " ".join(f"Title {k} {say(k)} {say(k + 10)}" for k in range(3))
    nav = "<nav><a href=x>home</a></nav>"
    assert html_text.main_text(f"<html><body>{nav}<div>{parts}</div><footer>f</footer></body></html>") == want
    assert html_text.main_text(f"<html><body>{nav}{parts}<footer>f</footer></body></html>") == want
    # A dense text outside a small article or main is the main text.
    dense = f"<div class=story><p>{say(1)}</p><p>{say(2)}</p><p>{say(3)}</p></div>"
    teaser = '<{0}><a href=x>See this</a> <a href=y>and that</a></{0}>'
    for tag in ("article", "main"):
        assert html_text.main_text(f"<html><body>{teaser.format(tag)}{dense}</body></html>") == f"{say(1)} {say(2)} {say(3)}"


# 9


def test_fingerprint():
    def slow(text):
        ws = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        if not ws:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in [None, "", " \n", "One", "a B", "É x y Z", "a b c d e f g a b c", "x\x1cy z w " * 300]:
        assert simhash.fingerprint(t) == slow(t)


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


@pytest.mark.parametrize("chunk", [7, 2048])
def test_links_connect_all_within_radius(spark, chunk):
    rng = np.random.default_rng(1)
    found = set()
    for b in rng.integers(0, 2**63, 25).tolist():
        for _ in range(50):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << k
            found.add(x)
    fps = np.array(sorted(found), np.uint64)
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), Scratch(spark, "t"), 3, chunk).collect()
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1]
    assert _roots(len(fps), [(place[e["a"]], place[e["b"]]) for e in edges]) == _roots(len(fps), near)
    assert chunk < 2048 or len(edges) < len(near)


def test_components(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    ids = [i for i, _, _ in docs]
    fps = np.array([simhash.fingerprint(t) for _, t, _ in docs], np.uint64)
    near = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1]
    for i, f, root in zip(ids, fps, _roots(len(fps), near), strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{int(f):016x}", ids[root])
    for find in (simhash.simhash_components, simhash.near_components):
        out = find(odd).collect()
        assert len(out) == odd.count() and sum(r["kept"] for r in out) == len({r["component_id"] for r in out})
        assert len({r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1 and find(none).count() == 0


def test_near_components(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts, group = [], []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        for _ in range(6):
            ws = list(base)
            for _ in range(len(ws) // 150):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            texts.append(" ".join(ws))
            group.append(g)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk=5).collect()}
    assert len(set(got.values())) == 40 and all(group[i] == group[c] for i, c in got.items())


def test_near_components_are_exact_at_the_similarity(spark):
    rng = random.Random(5)
    texts = []
    for g in range(150):
        base = [f"w{rng.randrange(50_000)}" for _ in range(rng.randint(150, 400))]
        changed = list(base)
        for k in range(0, len(base) - 5, round(len(base) / (len(base) * rng.uniform(0.018, 0.028)))):
            changed[k + rng.randrange(5)] = f"x{g}y{k}"
        texts += [" ".join(base), " ".join(changed)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    exact = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.76 <= x < 0.8 for x in exact) > 20 and sum(0.8 <= x < 0.83 for x in exact) > 20
    for chunk in (7, 2048):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk=chunk).collect()}
        assert [got[2 * k + 1] == 2 * k for k in range(150)] == [x >= 0.8 for x in exact]


def test_near_components_of_texts_that_repeat_a_line(spark):
    rng = random.Random(8)
    texts = []
    for few, many, words, line in ((1, 20, 200, 12), (2, 60, 300, 15)) * 10:
        w, x = ([f"w{rng.randrange(50_000)}" for _ in range(n)] for n in (words, line))
        texts += [" ".join(w + x * n) for n in (few, many)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


# 10


def test_base_spans():
    text = "a.b@c.de x@y +33 (0)1 23 45 67 89 end 1.2.3.4 256.1.1.1 card 4111 1111 1111 1111 or 4111111111111112 or 0012.3.4.5 or 4111 1111 1111 1111 12345"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("ip", "0012.3.4.5"), ("card", "4111 1111 1111 1111"), ("phone", "+33 (0)1 23 45 67 89")]
    assert pii.base_spans(None) == [] and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@-+_ 0,9") for _ in range(rng.randint(0, 60)))
        want = [("email", *m.span()) for m in pii.EMAIL.finditer(t)] + [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [x for x in pii.base_spans(t) if x[0] in ("email", "ip")] == want
    for long in ("1" * 200_000, "a" * 200_000 + "@", "@" * 200_000, "a@b." * 50_000, "1." * 100_000, "+1 (" * 50_000, "0" * 6000 + "1.2.3.4"):
        pii.base_spans(long)
        pii.SegmentModel().decode(long[:20_000])


def test_segment_model_adds_spans(spark, odd, none):
    model = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    say = lambda t: {(k, t[a:b]) for k, a, b, base in pii.all_spans(t, model) if not base}
    assert ("phone", "(743) 555-3824") in say("tel (743) 555-3824 ok")
    assert ("card", "4111.1111.1111.1111") in say("my card 4111.1111.1111.1111 ok")
    assert say("in 2019 we had 1,200 and 3.4.5 x") == set()
    assert len(pii.find(odd, model).collect()) == odd.count() and pii.find(none, model).count() == 0


def test_decoding_is_the_best_segmentation():
    model = pii.SegmentModel({"phone|": 1.0, "ip|": 1.5, "phone|n=8": 2.0, "card|": -9.0, "email|": -9.0, "touch": -0.5})
    text = "12 34.56.78 90"
    tokens = [m.span() for m in pii._token(text)]
    segments = pii.candidates(text, tokens)

    def best(j):
        if j == 0:
            return 0.0, False
        return max([(best(j - 1)[0], False), *[(best(i)[0] + model.value(k, f) - 0.5 * best(i)[1], True) for i, k, f in segments.get(j, ())]])

    place = {a: k for k, (a, _) in enumerate(tokens)} | {("end", b): k + 1 for k, (_, b) in enumerate(tokens)}
    total, prev = 0.0, None
    for kind, a, b in model.decode(text):
        i, j = place[a], place["end", b]
        total += model.value(kind, next(f for s, k, f in segments[j] if s == i and k == kind)) - 0.5 * (prev == i)
        prev = j
    assert total == pytest.approx(best(len(tokens))[0])


def test_added_spans_on_rewritten_and_new_kinds(duck):
    """Recall of what the patterns cannot see, on documents that the model was not trained on."""
    texts = [t for t, in duck.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY hash(doc_id)").fetchall() if re.search(r"@|[0-9]{4}", t)]
    train, held = texts[: len(texts) // 2], texts[len(texts) // 2 :]
    model = pii.SegmentModel({f"{k}|": -2.0 for k in pii.EVERY_KIND})
    model.train(pii._examples(train) + [(t, {(k, t.index(s), t.index(s) + len(s))} if k else set()) for t, k, s in pii.SEEDS] * 8)
    rng, hit, asked, wrong = random.Random(1), defaultdict(int), defaultdict(int), 0
    for t in held:
        secrets = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
        asked["secret"] += len(secrets)
        hit["secret"] += len(secrets & {(a, b) for k, a, b, _ in pii.all_spans(t, model) if k == "secret"})
        spans = pii.base_spans(t)
        for lo, hi in pii._pieces(t):
            gold = {(k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi}
            again = gold and pii._rewritten(t[lo:hi], gold, rng)
            if again:
                base = set(pii.base_spans(again[0]))
                added = {(k, a, b) for k, a, b, is_base in pii.all_spans(again[0], model) if not is_base and k != "secret"}
                for k, a, b in again[1] - base:
                    asked[k] += 1
                    hit[k] += (k, a, b) in added
                wrong += sum(not (k == "card" and pii.luhn(again[0][a:b])) for k, a, b in added - again[1])  # two numbers side by side are no base match, but cards
    assert min(asked.values(), default=0) >= 2 and set(asked) == {"secret", "email", "phone", "card"}
    assert all(hit[k] >= 0.9 * asked[k] for k in asked) and wrong <= 0.1 * sum(asked.values())


def test_pii_of_odd_rows(odd, none):
    model = pii.SegmentModel({"secret|": 1.0})
    got = pii.find(odd.withColumn("pii", F.lit("old")), model)
    assert got.columns == [*odd.columns, "pii"] and got.count() == odd.count()
    assert [r["pii"] for r in got.filter("doc_id = 1").collect()] == [[]]
    kept = pii.find(odd.withColumn("pii", F.lit("old")), model, into="spans")
    assert {r["pii"] for r in kept.collect()} == {"old"} and pii.find(none, model).count() == 0
    assert [(k, a, b) for k, a, b, _ in pii.all_spans("x ab_live_4eC39HqLyjWDarjtT1zdp7dc y", model)] == [("secret", 2, 34)]
    for long in ("a1" * 100_000, "a" * 200_000 + "1", "1a_" * 60_000, "@" * 300_000, "x@" * 150_000):
        pii.all_spans(long, pii.SegmentModel())


def test_digest(spark, docs):
    got = {r["doc_id"]: r for r in queries.op10_pii(spark, SF).collect()}
    for i, text, _ in docs:
        spans = pii.base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.digest(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(pii.digest(spans).split(",")) <= {*got[i]["spans"].split(","), ""}


# pipeline


def test_stages(spark, duck, none):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name == "best_fit_packing":
            assert out.select("doc_id").distinct().count() == frame.count()
            break
        assert out.columns == frame.columns and 0 < out.count() <= frame.count()
        path = f"{Scratch(spark, 'stage').root}/{name}"
        out.write.parquet(path)
        frame = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        out = stage(spark, odd, SF)
        n = {"exact_dedup": 8, "benchmark_decontamination": odd.count()}.get(name)
        assert n is None or out.count() == n
        if name != "best_fit_packing":
            assert out.columns == odd.columns and {r["score"] for r in out.collect()} == {0.5}


def test_fold(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
