import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_DIR
from storelens.llm.html_main import host_of, main_text, site_templates, subtrees, with_main_text
from storelens.llm.queries import op13_html_main


def test_parts_that_are_no_article():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> -->
    <div id="cookie-notice">Cookies</div><div class="ad">Buy</div><aside><p>Side</p></aside>
    <article class="post"><header><h1>Caf&eacute;  &lt;b&gt;</h1></header><p><b>One.<br><p>Two\n <i>th</i>ree&nbsp;four &am</p>
    <div class='share-links'><a href=x>Share</a></div><form><input><button>Go</button></form>
    <ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><blockquote>said</blockquote>tail</article>
    <section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page).split("\n") == ["Café <b>", "One.", "Two three four &am", "a", "b", "1", "2", "3", "said", "tail"]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<main><p>x</main><p>y", "x"), ("<div role=main><p>x</div>y", "x"),
    ("<p title='a>b' x=it's>c</p>", "c"), ("<!-->a<!-- b", "a"), ("a < b <3 &lt;p&gt;", "a < b <3 <p>"), ("<script>a", ""), ("a<SCRIPT>b</Script >c", "ac"),
    ("<article><p>x", "x"), ("<article>a</article><p>-</p><article>b</article>", "a\nb"), ("<div class=content-sidebar-wrap><article>a</article></div>", "a"),
    ("<nav>a<article>b</article></nav>", ""), ("<p>&#x41;&#66;&quot;&zzz;", 'AB"&zzz;'), ("</div></p><p>a</b></div>b", "ab"),
    ("<p hidden>a</p><p>b</p>", "b"), ("<article><div class=comment-list>x</div>y</article>", "y"), ("﻿<p>é ü</p>", "﻿\né ü"),
    ("<article><h1>x</h1><p>y</p>" + "<p>z " * 20_000, "x\ny" + "\nz" * 20_000)])
def test_small_pages(page, want):
    assert main_text(page) == want


def _site(n, host="a.example"):
    # no article element and no telling names: only the counts can tell the template
    return [(i, f"https://{host}/{i}", f"<body><div><div>Menu of the site</div><div>Story {i} begins</div><div>and ends {i % 2}</div>"
                                      f"<table><tr><td>Imprint</table></div></body>") for i in range(n)]


def test_template_by_host(spark):
    # two pages each end alike on a small host; the other host has too few pages for a template
    pages = _site(10) + [(100 + i, u, h) for i, u, h in _site(4, "b.example")] + [(200, None, "<div>Menu of the site</div>"), (201, "nowhere", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in with_main_text(df, least=5, share=0.6).collect()}
    assert len(got) == len(pages)
    for i in range(10):
        assert got[i] == f"Story {i} begins\nand ends {i % 2}"
    assert got[100] == "Menu of the site\nStory 0 begins\nand ends 0\nImprint" and got[200] == "Menu of the site" and got[201] == ""
    # the counts as plain Python makes them
    count = Counter(s for _, _, h in _site(10) for s in subtrees(h))
    (row,) = site_templates(df, least=5, share=0.6).collect()
    assert (row.host, row.pages) == ("a.example", 10) and row.template == sorted(s for s, n in count.items() if n >= 6)


def test_copies_of_a_page_are_no_template(spark):
    pages = [(i, "http://a.example/x", "<p>The same story</p><p>again</p>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.text for r in with_main_text(df).collect()} == {"The same story\nagain"}


def test_salted_join_equals_broadcast(spark):
    df = spark.createDataFrame(_site(30) + _site(12, "c.example"), "page_id long, url string, html string")
    rows = lambda **k: sorted(map(tuple, with_main_text(df, **k).collect()))
    assert rows() == rows(broadcast_bytes=0, pages_per_salt=7)


def test_edges(spark):
    empty = spark.createDataFrame([], "url string, html string, text string, _host int")
    got = with_main_text(empty)
    assert sorted(got.columns) == ["_host", "html", "text", "url"] and got.count() == 0
    rows = [("http://U:p@A.Example:8080/x", "a.example"), ("ftp://é.example", "é.example"), ("/x", None), ("", None), (None, None), ("http:///x", None)]
    got = spark.createDataFrame(rows, "url string, want string").select(host_of(F.col("url")).alias("h"), "want")
    assert all(r.h == r.want for r in got.collect())


def test_query_on_given_pages(spark):
    """The given pages have one layout: their article, read by plain patterns, is what must come out."""
    want = {}
    for r in spark.read.parquet(f"{SMALL_DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:h\d|p)>", body.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        want[r.page_id] = "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
    got = {r.page_id: r for r in op13_html_main(spark, SMALL_DIR).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
