"""Wrapper induction against plain recursion and against pages whose articles are known."""

import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tilewright.llm import wrappers
from tilewright.llm.wrappers import Place

SF = "/root/testdata/sf0.01"


def brute_match(a, b):
    """The largest common top-down tree that keeps order, by trying all ordered pairings of children."""
    if a.kind != b.kind:
        return 0
    most = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, n):
            for right in itertools.combinations(b.kids, n):
                each = [brute_match(x, y) for x, y in zip(left, right, strict=True)]
                if all(each):
                    most = max(most, sum(each))
    return 1 + most


def random_tree(rng, depth):
    return Place(str(rng.choice(["a", "b"])), kids=[random_tree(rng, depth - 1) for _ in range(rng.integers(0, 4))] if depth else [])


def test_simple_tree_matching():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = random_tree(rng, 2), random_tree(rng, 2)
        assert wrappers.tree_match(a, b, {}) == brute_match(a, b)
        pairs = list(wrappers.align(a.kids, b.kids, {}))
        assert [x for x, _ in pairs if x] == a.kids and [y for _, y in pairs if y] == b.kids
        if a.kind == b.kind:
            assert 1 + sum(brute_match(x, y) for x, y in pairs if x and y) == brute_match(a, b)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


def cms_page(rng, i, paragraphs):
    """A page without an article element; what repeats on all pages has no telling name."""
    body = "".join(f"<p>{html.escape(p)}" for p in paragraphs[1:])
    return f"""<html><head><title>{paragraphs[0]}</title><script>if (1 < 2) document.write("<p>no</p>")</script></head><body class="page-{i}">
<header class="masthead"><h1>The Daily</h1><a href=/>home</a></header>
<div class="x1"><div>Read us each day, dear readers, at no cost and with no end</div>
<ul class="k"><li><a href=a>{words(rng, 2)}</a><li><a href=b>{words(rng, 2)}</a></ul>
<div id="c-{i}"><h2>{paragraphs[0]}</h2>{body}<div>Written by our own staff in our own rooms</div></div></div>
<div class="comments"><p>{words(rng, 30)}</p></div><aside><p>{words(rng, 20)}</p></aside>
<form><p>Your name</p><input></form><div class="cookie-notice">{words(rng, 9)}</div><footer>all rights {i}</footer></body></html>"""


def test_a_site_without_article_elements(spark):
    """Constant boxes go, wherever they are; menus, comments, asides, forms, notices and footers too, although they vary."""
    rng = np.random.default_rng(5)
    pages, want = [], {}
    for i in range(40):
        paragraphs = [words(rng, 5), *(words(rng, 40) for _ in range(1 + i % 4))]
        pages.append((i, f"https://Site.example/{i}?q", cms_page(rng, i, paragraphs)))
        want[i] = "\n".join(paragraphs)
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def article_page(i, title, paragraphs):
    return (
        f"<body><nav><ul><li><a href=/{i}>n{i}</a></ul></nav><article><h1>{title}</h1>" + "".join(f"<p><b>{p}<br>" for p in paragraphs) + "<div class='share'>tell all</div>"
        f"<div>Get our paper by post</div></article><footer>f{i}"
    )


def test_copies_are_no_template(spark):
    """Most pages of a host are copies of one article; another host has nothing else; a third has two pages."""
    same = ["one and the same", "text on and on"]
    rows = [(i, "http://a/x", article_page(i, "Same", same)) for i in range(30)]
    rows += [(100 + i, "http://a/y", article_page(i, f"T{i}", [f"own words {i}", "text on and on"])) for i in range(6)]
    rows += [(200 + i, "http://b/x", "<body><article><h1>Same</h1><p>one and the same</article>") for i in range(9)]
    rows += [(300 + i, "http://c/x", f"<body><article><h1>Same</h1><p>body {i}</article>") for i in range(2)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows:
        if i < 100:
            assert got[i] == "Same\none and the same\ntext on and on"
        elif i < 200:
            assert got[i] == f"T{i - 100}\nown words {i - 100}\ntext on and on"
        elif i < 300:
            assert got[i] == "Same\none and the same"
        else:
            assert got[i] == f"Same\nbody {i - 300}"


def parsed_blocks(page):
    out, todo = [], [wrappers.parse(page)]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            out.append(x[0])
        else:
            todo.extend(reversed(x.kids))
    return out


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain &amp; simple &copy; &#x41;&#66; &bogus; a < b &lt;p&gt;", ["plain & simple © AB &bogus; a < b <p>"]),
        ("<p>one<p>two<div>three</div>four</p>five", ["one", "two", "three", "four", "five"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a</div>b<td>c</table>d", ["ab", "c", "d"]),
        ("<p>a<b>b<i> c</b></i>\n\td&nbsp;e<br>f", ["ab c d e f"]),
        ("<script>var a='<p>x</p>'</script><style>p{}</style>y<!-- <p>z</p> -->w<noscript>q</noscript>", ["yw"]),
        ('<p title="a > b" x=\'<p>\'>t</p><p class=it\'s>u</p><p data-x="never closed>v', ["t", "u", "v"]),
        ("<p>cut <b", ["cut"]),
        ("<p>cut</p><!-- off <p>never", ["cut"]),
        ("<SCRIPT>x</SCRIPT><P>Y</P><button>z</button><span class='ad'>buy <span>now</span></span>w", ["Y", "w"]),
        ("<textarea><p>x</textarea>y<svg><title>t</title><text>u</text></svg>v", ["yv"]),
    ],
)
def test_parsing(page, blocks):
    assert parsed_blocks(page) == blocks


def test_no_text_is_lost_to_depth_or_size():
    deep = "".join(f"<div>w{i}" for i in range(3000)) + "</div>end" * 3000
    assert parsed_blocks(deep) == [f"w{i}" for i in range(3000)] + ["end"] * 3000
    random.seed(1)
    mixed = "<body>" + "".join(random.choice(["<div class=a>", "</div>", "<p>", "<h2>", "<section>", "</section>", "<li>"]) + f"w{i} " for i in range(4000))
    assert " ".join(parsed_blocks(mixed)).split() == [f"w{i}" for i in range(4000)]
    big = wrappers.prune(wrappers.fold(wrappers.parse(mixed)))
    assert big.size <= wrappers.NODES
    long = "<article><p>" + "word " * 400_000 + "</article>"
    assert wrappers.extract(long, None) == ("word " * 400_000).strip()


def test_broken_markup_takes_linear_time():
    for page in ("<p x=\"" * 20_000, "<" * 100_000, "<a href='" * 20_000 + "'>", "<!--" * 50_000, "<script>" * 20_000, "&" * 100_000, "<p a=b" * 20_000, "<ul><li>" * 3_000):
        wrappers.extract(page, None)


def test_odd_rows(spark):
    page = "<article><p>x y</article>"
    rows = [(1, "http://a/", page), (1, "http://a/", page), (None, "http://a/", page), (2, None, page), (3, "not a url", page), (4, "http://a/", None), (5, "http://a/", ""), (6, "//b.c/d", page)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, text string, wrapper string")
    got = wrappers.main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted(((i, u, "x y" if h else "", 3 if h else 0) for i, u, h in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert wrappers.main_text(frame.limit(0)).collect() == []


def test_large_wrappers_are_joined_not_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}/", article_page(i, f"T{i}", [f"own words {i}"])) for i in range(70)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = {tuple(r) for r in wrappers.main_text(frame).collect()}
    monkeypatch.setattr(wrappers, "BROADCAST", 0)
    monkeypatch.setattr(wrappers, "HELD", 2)
    assert {tuple(r) for r in wrappers.main_text(frame.repartition(20)).collect()} == small


def test_given_pages(spark):
    """Articles of the given pages as a pattern for their one layout finds them."""
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    want = {}
    for i, page in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want[i] = "\n".join(p for p in parts if p)
    got = {r.page_id: r.text for r in wrappers.op13_main_text(spark, SF).collect()}
    assert got == want


TEXT = "Some words of a text that goes on and on, as texts do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><header><h1>Site</h1></header><div id=content><h1>T</h1><p>{TEXT}</div><div class=rightSidebar>x y z</div>", f"T\n{TEXT}"),
        (f"<body><div class='content-sidebar-wrap'><main><p>{TEXT}</main><div class=sidebar>x</div></div>", TEXT),
        (f"<body><nav>a</nav><article><header><h1>T</h1></header><p>{TEXT}<figure><figcaption>F</figcaption></figure><ul><li>i<li>j</ul><aside>no</aside></article><ol class=commentlist><li>c</ol>", f"T\n{TEXT}\nF\ni\nj"),
        (f"<body class=has-sidebar><div id=siteFooter>f</div><div role=main><p>{TEXT}</p><form>q</form></div>", TEXT),
        (f"<body><div class=post><p>{TEXT}<p>{TEXT}</div><section id=comments><article class=comment><p>{TEXT}</article></section><dialog>d</dialog>", f"{TEXT}\n{TEXT}"),
        (f"<table><tr><td><a href=1>m</a><br><a href=2>n</a><td><h2>T</h2><p>{TEXT} <a href=3>more</a></table>", f"T\n{TEXT} more"),
        (f"<div style='display: none'>hid</div><div hidden>den</div><p>{TEXT}", TEXT),
    ],
)
def test_pages_by_themselves(page, text):
    assert wrappers.extract(page, None) == text
