"""Main text of pages: densities against a naive reading of the formulas, hostile pages, wrappers, odd tables."""

import math
import random
import re
import time
from collections import Counter

import pytest

from terrapix.llm import html_text
from terrapix.llm.html_text import Node, main_text, measure, parse, sums

SF = "/root/testdata/sf0.01"


def _say(k, n=12):
    return " ".join(f"Part {k} tells of word{k}x{j} and goes on at some length about it." for j in range(n))


def _random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if depth > 4 or kind < 0.4:
            out.append(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))))
        else:
            tag = rng.choice(["div", "div", "section", "p", "a", "b", "ul"])
            inner = "text only" if tag in ("p", "a") and rng.random() < 0.5 else _random_page(rng, depth + (9 if tag in ("p", "a") else 1))
            out.append(f"<{tag}>{inner}</{tag}>")
    return "".join(out)


def test_densities_are_those_of_the_formulas():
    def kids(x):
        return [p for p in x.parts if isinstance(p, Node)]

    def every(x):
        return [y for k in kids(x) for y in (k, *every(k))]

    def characters(x):
        return sum(len(re.sub(r"\s", "", p)) if isinstance(p, str) else characters(p) for p in x.parts)

    def in_links(x):
        return characters(x) if x.tag == "a" or within_link(x) else sum(in_links(k) for k in kids(x))

    def within_link(x):
        return x.parent is not None and (x.parent.tag == "a" or within_link(x.parent))

    def density(x, body):
        c, lc = characters(x), in_links(x)
        t, lt = len(every(x)), sum(y.tag == "a" for y in every(x))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + in_links(body) / max(characters(body), 1) * c + math.e)
        return max(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base), 0.0)

    rng = random.Random(4)
    for _ in range(60):
        root = parse(f"<html><body>{_random_page(rng)}</body></html>")
        order, body = measure(root)
        sums(order, html_text.OUT)
        for x in order:
            assert x.density == pytest.approx(density(x, body))
            assert x.total == pytest.approx(sum(density(k, body) for k in kids(x)) or density(x, body))
        blocks = [x for x in order if x.chars and x.tag in html_text.BLOCKS and x in (body, *every(body))]
        if blocks:
            assert body.best.total == pytest.approx(max(x.total for x in blocks))


def test_density_decides_without_names(duck):
    precision, recall = [], []
    for page, in duck.execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        want = main_text(page)
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)article", r"<\1div", page))
        a, b = Counter(main_text(bare).split()), Counter(want.split())
        both = sum((a & b).values())
        precision.append(both / max(sum(a.values()), 1))
        recall.append(both / max(sum(b.values()), 1))
    assert sum(precision) / len(precision) > 0.9 and sum(recall) / len(recall) > 0.9


@pytest.mark.parametrize("name", ["content with-sidebar", "layout has-sidebar", "page-widget", "single-related", "social-science", "content sidebar-right", "notice", "site-menu-open", "entry-header"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_wrapper_is_not_judged_by_its_name(name, tag):
    body = f"<h1>The title of it</h1><p>{_say(1)}</p><p>{_say(2)}</p>"
    page = f"<html><body><nav><a href=x>home</a></nav><div class='{name}'><{tag}>{body}</{tag}></div><footer>The foot</footer></body></html>"
    assert main_text(page) == f"The title of it {_say(1)} {_say(2)}"


def test_parts_that_name_themselves_are_left_out():
    inner = f"<div class='entry-header'><h1>The title</h1></div><p>{_say(1)}</p><div class='ad-slot'>{_say(7, 2)}</div><p>Short.</p><p>{_say(2)}</p><aside>{_say(8, 2)}</aside>"
    comments = f"<div class='comments'><div class=comment><p>{_say(9)}</p></div><div class=comment><p>{_say(10)}</p></div></div>"
    notice, form = "<div id=cookie-notice>We use cookies here, as all do, and you may say no to it.</div>", "<form><label>Your name and your mail</label><input></form>"
    share = "<div class='share-bar'><a href=a>One</a> <a href=b>Two</a></div>"
    want = f"The title {_say(1)} Short. {_say(2)}"
    for tag in ("article", "main", "div"):
        assert main_text(f"<body><header><h1>Site</h1></header>{notice}<nav><a href=x>h</a></nav><{tag}>{inner}{share}</{tag}>{comments}{form}<footer>{_say(3, 1)}</footer></body>") == want
        assert main_text(f"<body>{notice}<div class=wrap><{tag}>{inner}</{tag}>{comments}</div><div class=sidebar>{_say(4)}</div></body>") == want


def test_forms_around_the_page_and_headings_before_the_text():
    text = f"<div><p>{_say(1)}</p><p>{_say(2)}</p></div>"
    assert main_text(f"<body><form action=x><div class=page>{text}</div><input></form><footer>f</footer></body>") == f"{_say(1)} {_say(2)}"
    assert main_text(f"<body><nav><a href=x>h</a></nav><h1>Title</h1>{text}<footer>f</footer></body>") == f"Title {_say(1)} {_say(2)}"
    assert main_text(f"<body><div id=a><section><h2>One</h2><p>{_say(1)}</p><p>{_say(2)}</p></section><p>Between.</p><section><h2>Two</h2><p>{_say(3)}</p></section></div></body>") == f"One {_say(1)} {_say(2)} Between. Two {_say(3)}"


def test_markup_that_is_no_markup():
    assert main_text("<p don't>It isn't <b title=it's>so</b> bad</p>") == "It isn't so bad"
    assert main_text('<p title="a > b">x &lt; y &amp;amp; z</p><![CDATA[ no > ]]><?php no ?><!doctype x>') == "x < y &amp; z"
    assert main_text("<p>5 < 6 and <3 but </ 7> no</p>") == "5 < 6 and <3 but no"
    assert main_text('<p title="open>one</p><p>two</p>') == "one two"
    assert main_text("<SCRIPT>if (a<b) {}</sCript ><P>x<STYLE>p{}</STYLE></P><script>left open <p>no</p>") == "x"
    assert main_text("<p>a<span hidden>no</span><span aria-hidden=true>no</span>b</p>") == "ab"


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"", "<a =\">\" ", "<", "</", "<!--", "<![CDATA[", "<!", "<?", "&amp", "<span>", "<div>", "<li>", "<p><b>", "<table><tr><td>", "<ul><li>", "<span></em>", "<em><article></em>", "<a 'x' ", "<script", "<h1>t</h1>"])
def test_hostile_pages_take_linear_time(piece):
    page = "<body><p>first text</p>" + piece * (200_000 // len(piece))
    began = time.time()
    assert main_text(page).startswith("first text") or "<" in piece
    assert time.time() - began < 12


def test_a_megabyte_of_open_tags():
    began = time.time()
    for piece in ("<a ", "</b>", "<span>x</em>"):
        main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 60


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    page = f"<body><nav><a href=x>h</a></nav><div><p>{_say(1)}</p></div></body>"
    data = [(1, None, None, "old", None), (2, "u", "", "old", 1), (3, "u", page, "old", 1), (3, "u", page, "old", 1), (None, "u", "<p>😀 x</p>".encode("utf-16", "surrogatepass").decode("utf-16"), None, 1)]
    df = spark.createDataFrame(data, schema)
    got = html_text.extract(df)
    assert got.columns == df.columns and sorted(r["text"] for r in got.collect()) == sorted(["", "", _say(1), _say(1), "\U0001f600 x"])
    kept = html_text.extract(df, into="main_text").collect()
    assert {r["text"] for r in kept} == {"old", None} and {r["main_text"] for r in kept} == {"", _say(1), "\U0001f600 x"}
    assert html_text.extract(df.limit(0)).count() == 0
