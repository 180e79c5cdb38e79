import html
import re
import time

import pytest

from trolley.llm.html_text import content, extract

DATA = "/root/testdata/sf0.001"


def test_article_among_boilerplate():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A long menu entry for a long page</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, it is
    really cheap and good.</div><article><h1>Head &amp; tail</h1><p><b>One   two<br>three.<p>Short.</p><aside>Read also</aside>
    <ul><li>x<li>y</ul></article><section id="comments"><p>A long reader comment that should not be there at all.</p></section>
    <footer>&copy; somebody</footer>"""
    assert content(page) == ["Head & tail", "One two three.", "Short.", "x", "y"]


def test_pages_without_an_article():
    page = """<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies on this page</div>
    <div id="content"><h2>Title</h2><p>A paragraph with some length to it, as text has.</p><div class="ad-box">Buy!</div><p>End.</p>
    <form><label>Mail</label><input></form></div><div class="comments"><p>I liked it a lot, a great long text.</p></div>"""
    assert content(page) == ["Title", "A paragraph with some length to it, as text has.", "End."]
    assert content("plain &lt;text&gt;") == ["plain <text>"]
    assert content("<main><p>a</p></main><p>outside the main part of the page, and longer</p>") == ["a"]


def test_broken_and_empty_pages():
    assert content("") == content("<script>x</script><nav>y</nav>") == content("<div></div>") == []
    assert content("<p>a<p>b</div></x>c<script>if(a<b){'</p>'}</script>&eacute;&#233;") == ["a", "b", "céé"]
    assert content("<article><p>open <b>and never closed") == ["open and never closed"]


def test_nothing_else_is_dropped():
    page = """<nav>A menu</nav><article><p>The area is <math>x=2</math> metres <span aria-hidden="true">visible words</span> and goes
    on</p><p style="display:none">Kept</p><button>Press</button><ul class="tags"><li>one</li></ul><div class="related">See this</div></article>"""
    assert content(page) == ["The area is x=2 metres visible words and goes on", "Kept", "Press", "one", "See this"]


def test_inline_boilerplate_leaves_its_line_whole():
    assert content('<article><p>one <span class="ad">Buy!</span>two</p><a class="promo"><div>No</div></a><p>three</article>') == ["one two", "three"]
    assert content('<p>one <a class="share">Share</a> two</p><p><span class="cookie">We use cookies</span></p>') == ["one two"]


def test_head_without_an_end():
    assert content("<head><title>T</title><style>p{}</style><p>text") == ["text"]


@pytest.mark.parametrize("page, want", [
    ("<div>" * 200_000 + "x", ["x"]), ("<div>" * 200_000 + "x" + "</p>" * 200_000, ["x"]), ("<span>" * 200_000 + "x" + "</b>" * 200_000, ["x"]),
    ("<ul><li>" * 100_000 + "x", ["x"]), ("<div><p>x</div>" * 100_000, ["x"] * 100_000), ("<article>x</article>" * 50_000, ["x"] * 50_000),
    ("<b>" * 100_000 + "<p>x</p>" * 100_000, ["x"] * 100_000), ("<p>x</p><aside>y</aside>" * 50_000, ["x"] * 50_000),
    ('<b><div class="ad"></b>x' * 50_000, ["x"] * 1), ("x&amp;" * 500_000, ["x&" * 500_000]),
])
def test_time_grows_with_the_length_of_a_page(page, want):
    start = time.process_time()
    found = content(page)
    assert time.process_time() - start < 20
    assert found == want or "ad" in page


def test_data_pages_and_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    more = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p>x</p>" * 5000)], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", "html").unionAll(more)
    found = {r.page_id: r for r in extract(rows).collect()}
    assert found[-1].text == found[-2].text == "" and found[-3].text == "\n\n".join(["x"] * 5000)
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in blocks]
        assert found[r.page_id].text == "\n\n".join(b for b in blocks if b)
    assert extract(rows.limit(0)).collect() == []
