"""Main text of pages of several layouts."""

from __future__ import annotations

import random
import re
import time

import pytest

from tessella.llm import maintext

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy</div><article><h1>Head &amp; shoulders</h1><p><b>First   line.<br><p>Second &eacute;&nbsp;&lt;b&gt;\n line.</p></article><footer>&copy; me</footer></body></html>"""
DIVS = """<html><body><div id="header"><a href="/">Home</a></div><div class="menu top"><a href="/a">A</a> <a href="/b">B</a></div><div class="wrap-{n}"><div class="post-body"><h2>Title {n}</h2><p>A long paragraph of the post number {n}, with words and words.</p>
<ul><li>one</li><li>two</li></ul><p>Another long paragraph with <a href="/l">a link</a> inside of it.</p><form><label>Name</label><input></form><blockquote>Quoted words.</blockquote></div><div class="sidebar">Side words that nobody wants to read at all, even though there are many.</div>
<section class="comments"><p>First! This is a comment by a reader that is long as well.</p></section></div><div class="cookie-notice">We use cookies</div></body></html>"""


def test_an_article_without_what_surrounds_it():
    page = maintext.Page(ARTICLE)
    assert page.text(page.best()[0]) == "Head & shoulders\nFirst line.\nSecond é <b> line."


def test_a_layout_of_divs():
    page = maintext.Page(DIVS.replace("{n}", "5"))
    path, _ = page.best()
    assert page.names(page.paths.index(path)) == ">html>body>div.wrap-0>div.post-body"
    assert page.text(path).split("\n") == ["Title 5", "A long paragraph of the post number 5, with words and words.", "one", "two", "Another long paragraph with a link inside of it.", "Quoted words."]


@pytest.mark.parametrize(("html", "expected"), [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div><p>open <b>bold", "open bold"), ("<p>x &am y &amp z</p>", "x &am y & z"), ("a < b and <3", "a < b and <3"),
    ("<p>one</p><script>if (a<b) { x = '<p>no</p>' }</script><p>two</p>", "one\ntwo"), ("<p title='a>b'>q</p>", "q"), ("<!-- never closed <p>x</p>", ""), ("<p>a<br>b<br/>c</p>", "a b c"), ("</p></div>stray", "stray"),
])
def test_odd_markup(html, expected):
    page = maintext.Page(html)
    best = page.best()
    assert page.text(best[0] if best else None) == expected


def test_hosts_vote_and_pages_follow(spark):
    rows = [(i, f"https://h.example/{i}", DIVS.replace("{n}", str(i))) for i in range(6)]
    # On one page of the host an aside outweighs the post, but the host's path holds.
    odd = DIVS.replace("{n}", "77").replace('<div class="sidebar">', '<div class="extra"><p>' + "Many more words than the post has. " * 20 + "</p></div><div class='sidebar'>")
    rows += [(50, "https://h.example/odd", odd), (60, "http://other.example:80/x", ARTICLE), (61, None, None), (62, "not a url", "words only"), (63, "https://h.example/plain", "<p>no container of that path</p>")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, path int")
    found = {r.page_id: r for r in maintext.extract(pages).collect()}
    assert len(found) == len(rows)
    assert found[50].text.startswith("Title 77\nA long paragraph of the post number 77")
    assert "Many more words" not in found[50].text
    # Without the vote the odd page gives the aside.
    alone = maintext.Page(odd)
    assert alone.text(alone.best()[0]).startswith("Many more words")
    assert found[60].host == "other.example" and found[60].text.startswith("Head & shoulders")
    assert found[61].text == "" and found[61].host == ""
    assert found[62].text == "words only"
    assert found[63].text == "no container of that path"
    assert maintext.extract(pages.limit(0)).collect() == []


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert maintext.Page(deep).text(maintext.Page(deep).best()[0]) == "core"
    long_page = "<article>" + "<p>words and words</p>" * 20000 + "</article>"
    page = maintext.Page(long_page)
    assert page.text(page.best()[0]).count("\n") == 19999


def plain_tags(html):
    """Tags by a regular expression that backtracks, for pages whose quotes are closed."""
    found = re.finditer(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", html, re.S)
    return [(m.start(), m.end(), (m[2] or "").lower(), m[3] or "", m[1] == "/") for m in found]


def test_tags_are_those_of_a_plain_expression():
    rng = random.Random(3)
    pieces = ["<div class='a'>", "<p>", "</p>", "text ", "<b title=\"x>y\">", "</b >", "<!-- c > -->", "<!doctype html>", "< 3", "<br/>", "&amp;", "<a href=x>", "</a>", "<1>", "</>", "\n"]
    for _ in range(500):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert list(maintext.tags(html)) == plain_tags(html)


@pytest.mark.parametrize("piece", ["<a", "<a b='", "<a b=\"", "<", "</", "<a \">\" ", "<!--", "<!", "<b>", "</b>", "<div>", "<b><div>", "<p>x", "<li><b>y", "</script ", "&", "&#", "<a =", "<table><tr><td>", "</p></div></b>"])
@pytest.mark.parametrize("ends", [("", ""), ("<script>", ""), ("<b>" + "<div>" * 20_000, "'>"), ("words ", ">"), ("<p>words</p>", "'\" >")])
def test_hostile_markup_takes_time_in_proportion(piece, ends):
    began = time.process_time()
    page = maintext.Page(ends[0] + piece * 50_000 + ends[1])
    best = page.best()
    page.text(best[0] if best else None)
    assert time.process_time() - began < 20


def test_a_million_unclosed_tags_and_long_classes():
    article = "<article><p>The words of the article.</p></article>"
    html = "<html><body>" + article + "<a" * 1_000_000
    page = maintext.Page(html)
    assert page.text(page.best()[0]) == "The words of the article."
    # Ten levels of long classes do not make other elements one with the article.
    deep = "".join(f'<div class="{"c" * 500}{chr(97 + i)}">' for i in range(10))
    page = maintext.Page(f"<body>{deep}<div class='text'><p>The words of the article, all of them.</p></div><div class='more'><p>Other</p></div>")
    assert page.text(page.best()[0]) == "The words of the article, all of them."
