"""Extraction of main text."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from kvspace.llm import html

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class=cookie-notice>We use cookies</div><div id="wrap"><article class="post-12"><header><h1>T &amp; U</h1></header><p>One &lt;b&gt;
 line<p>Two <em>b</em>old&nbsp; x<br>y<ul><li>a<li>b</ul><div class="adBox ad">buy</div><form><p>mail</p></form><script>if(a<b){"</p>"}</script><!-- <p>no</p> -->
<table><tr><td>c1<td>c2</table><section id="comments"><p>nice</p></section></article></div><aside>s</aside><footer>f</footer></body></html>"""
TEXT = "T & U\nOne <b> line\nTwo bold x y\na\nb\nc1\nc2"


def test_extract():
    path, score = html.propose(PAGE)
    assert path == "html/body.has-sidebar/div/article.post-#" and score > 0
    assert html.extract(PAGE, path) == html.extract(PAGE, None) == html.extract(PAGE, "html/elsewhere") == TEXT


def test_without_markup_or_text():
    assert html.extract(None, None) == html.extract("", "x") == html.extract("<p><div></div>", None) == ""
    assert html.extract("just text &eacute;", None) == "just text é"
    assert html.extract("<div><p>open <b>never closed", None) == "open never closed"
    assert html.extract("<p>a</p></div></p><p>b", None) == "a\nb"
    assert html.extract("<p>a<!-- open comment <p>b", None) == "a"
    assert html.extract("<p>" + "x " * 50_000, None) == ("x " * 50_000).strip()


def test_container_without_article():
    page = "<body><div class='top menu'>menu</div><div class='story'><div><p>" + "word " * 50 + "</p></div><div><p>" + "more " * 50 + "</p></div></div><div>small</div></body>"
    assert html.extract(page, html.propose(page)[0]) == ("word " * 50).strip() + "\n" + ("more " * 50).strip()


def test_hosts_vote(spark):
    good = "<body><div class='main'><p>" + "text " * 40 + "</p></div><div class='x'><p>{}</p></div></body>"
    rows = [(i, "http://A.com/p", good.format("s")) for i in range(5)]
    rows += [(5, "https://a.com/q", good.format("long aside " * 80)), (6, None, "<p>alone</p>"), (7, "http://b.com", None), (7, "http://b.com", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS host")
    for most in (html.MAX_HOSTS, 0):
        found = html.extract_pages(pages, most)
        assert found.columns == ["page_id", "url", "text", "n_chars"]
        got = sorted((r.page_id, r.text, r.n_chars) for r in found.collect())
        assert got[5][1] == ("text " * 40).strip()  # the host's path, not the page's longest part
        assert got[6][1:] == ("alone", 5) and got[7][1:] == got[8][1:] == ("", 0)
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_nothing_of_an_article_goes_by_one_word():
    page = "<body><nav>menu</nav><article><p>first<p class=related>second<div class='share-price'>third</div><div class=legal>fourth</div><div class=form-guide>fifth</div><p>x <math>y</math> <label>z</label></p></article>"
    assert html.extract(page, html.propose(page)[0]) == "first\nsecond\nthird\nfourth\nfifth\nx y z"
    linked = page.replace("fourth", "<a href=/t>terms of use</a>, <a href=/p>privacy</a>").replace("third", "<a href=/q>quotes</a>")
    assert html.extract(linked, None) == "first\nsecond\nfifth\nx y z"
    outside = "<body><div class=legal>terms</div><div class=widget>w</div><div><p>" + "text " * 9 + "</p></div>"
    assert html.extract(outside, None) == ("text " * 9).strip()


def test_headings_beside_the_container():
    for n in (3, 3000):
        page = "<body><div class=menu>m</div><h1>Title</h1><p>Lead</p><div class=text>" + "<p>words of the text</p>" * n + "</div><div>other</div>"
        assert html.extract(page, html.propose(page)[0]).split("\n")[:3] == ["Title", "Lead", "words of the text"]
    page = "<main><h1>Title</h1><article><p>" + "one " * 30 + "</p></article><p>" + "two " * 25 + "</p></main>"
    assert html.extract(page, None).split("\n")[0] == "Title" and "two" in html.extract(page, None)


def test_time_follows_length():
    took = {}
    for name, page in {
        "quote": "<a " * 350_000 + '"',
        "equals": "<a =" * 250_000 + '"',
        "nested": "<div>" * 100_000 + "deep",
        "closed": "<div>" * 100_000 + "x</b>" * 100_000,
        "paragraphs": "<table>" + "<div>" * 50_000 + "<p>a" * 50_000,
        "raw": "<script>" + "</script" * 100_000,
        "comments": "<!-- " * 200_000,
        "blocks": "<div class=a><div class=b>" * 40_000 + "<p>t" * 40_000,
    }.items():
        begun = time.perf_counter()
        path, _ = html.propose(page)
        html.extract(page, path)
        took[name] = time.perf_counter() - begun
    assert max(took.values()) < 8, took
    assert html.extract("<div>" * 100_000 + "deep", html.propose("<div>" * 100_000 + "deep")[0]) == "deep"


def test_votes_decide_without_article(spark):
    """On a page whose comments are longer than its story, the host's other pages tell which is which."""
    page = "<body><div class=story><p>{}</p></div><div class=below><p>{}</p></div>"
    rows = [(i, "http://n.org/a", page.format("story " * 60, "short")) for i in range(4)] + [(9, "http://n.org/b", page.format("brief story", "long talk " * 200))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract_pages(pages).collect()}[9] == "brief story"
    assert {r.host: r.path for r in html.host_paths(pages.selectExpr("html", "'n.org' AS host")).collect()} == {"n.org": "body/div.story"}


class Article(HTMLParser):
    """The blocks of the article element, by the standard library's parser; enough for the pages of the test tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "h2", "ul", "li", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        own = Article()
        own.feed(r.html or "")
        own.close()
        assert found[r.page_id] == "\n".join(x for x in (" ".join(b.split()) for b in own.blocks) if x), r.page_id


BODY = "A long paragraph of the article, with commas, that is long enough to be its text. " * 3


@pytest.mark.parametrize("name", ["user-comments", "article-comments", "comment-thread", "comment-body", "post-sidebar", "cookie-law-info", "adsbygoogle", "readerComments"])
def test_comments_and_sidebars_inside_articles(name):
    for mark in (f'class="{name}"', f'id="{name}"'):
        page = f"<body><article><h1>T</h1><p>{BODY}</p><div {mark}><p>Somebody said, at length, that it is so.</p></div><p>The end, {BODY}</p></article></body>"
        assert html.extract(page, None) == f"T\n{BODY.strip()}\nThe end, {BODY.strip()}"


@pytest.mark.parametrize("name", ["social", "notice", "login", "has-sidebar", "single comments-open"])
def test_names_that_articles_have_too(name):
    """A weak name is boilerplate beside the text, and none around it."""
    around = f'<body><div class="{name}"><h1>T</h1><p>{BODY}</p><p>{BODY}</p></div></body>'
    assert html.extract(around, None) == "\n".join(["T", BODY.strip(), BODY.strip()])
    beside = f'<body><div><h1>T</h1><p>{BODY}</p><div class="{name}"><p>Log in or follow us.</p></div></div></body>'
    assert "follow" not in html.extract(beside, None)


def test_dropped_elements_break_no_block():
    page = f"<body><article><p>{BODY}a<select><option>x<option>y</select>c</p><p>b<button><div>z</div></button>d</p></article></body>"
    assert html.extract(page, None) == f"{BODY}ac\nbd"
