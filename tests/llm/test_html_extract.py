"""Main text of planted pages, and of the given ones against a plain reading."""

import random
from html.parser import HTMLParser

import pytest

from starlane.llm import html_extract as hx
from starlane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
P = ["A first paragraph that is long enough to be the text of an article on some page, with <b>bold</b> words.", "Short.", "Tom &amp; Jerry said &#8220;no&#8221; &mdash; twice,\n  and   then went home to <a href='/x'>read the news</a> about it."]
WANT = [
    "A first paragraph that is long enough to be the text of an article on some page, with bold words.",
    "Short.",
    "Tom & Jerry said “no” — twice, and then went home to read the news about it.",
]
BODY = "".join(f"<p>{p}</p>" for p in P)
TEXT = "\n\n".join(WANT)
MENU = "<ul>" + "".join(f"<li><a href='/{k}'>Entry {k}</a></li>" for k in range(8)) + "</ul>"

PAGES = {
    "article with everything around it": (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site of some length, the best of all sites in the world"
        f"</p></header><nav>{MENU}</nav><article><h1>Title</h1>{BODY}</article><aside><p>Sidebar text that is long enough to be mistaken for a part of"
        "it</p></aside><section id='comments'><article class='comment'><p>A reader's comment that goes on for quite a while, as such comments often do."
        "</p></article></section><footer>&copy; Somebody</footer></body></html>",
        "Title\n\n" + TEXT,
    ),
    "main without article": (f"<body><div class='cookie-notice'><p>We use cookies to make this page better for you and for us.</p></div><main><h1>T</h1>{BODY}</main>", "T\n\n" + TEXT),
    "neither": (f"<body><div id=top>{MENU}</div><div class=text>{BODY}</div><div class=sidebar><p>Elsewhere: a long text about something that is not this page's subject.</p></div><div>{MENU}</div><div>(c) me</div>", TEXT),
    "advert, script and form inside": (
        f"<article><p>{P[0]}</p><div class='ad'><p>Buy now, before all of it is gone for good!</p></div><script>var a = '<p>not text</p>';</script><p>{P[1]}</p>"
        f"<form><label>Mail</label><input name=m><button>Send</button></form><p>{P[2]}</p></article>",
        TEXT,
    ),
    "inline scripts and buttons do not part a block": ("<article><p>One <script>x()</script>two<button>B</button> three<br>four<wbr>five</p></article>", "One two three fourfive"),
    "tags left open": (f"<body><div class=ad>Advert never closed<article><p>{P[0]}<p>{P[1]}<p>{P[2]}", TEXT),
    "notice never closed ends with the article": (f"<article>{BODY}<div class=notice>Mind the gap</article><article><p>More of it.</p></article>", TEXT + "\n\nMore of it."),
    "one big form": (f"<form id=f><div>{BODY}</div><input type=submit></form>", TEXT),
    "unclosed comment": (f"<article>{BODY}<!-- and so on <p>never seen</p></article>", TEXT),
    "markup as text": ("<article><p>1 &lt;b&gt; 2 < 3 and 4 > 2 &copy 5 &unknown; </p></article>", "1 <b> 2 < 3 and 4 > 2 © 5 &unknown;"),
    "tag with a bracket in an attribute": ("<article><p title='a > b' data-x=\"</p>\">Text</p></article>", "Text"),
    "list and table": ("<article><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "one\n\ntwo\n\na b\n\nc"),
    "nothing but chrome": (f"<body><nav>{MENU}</nav><footer>Imprint</footer></body>", ""),
    "no markup": ("Just a text.", "Just a text."),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_planted_pages(name):
    page, want = PAGES[name]
    assert hx.extract(page) == want


def test_window_sums_against_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        weight = [rng.choice([0, 0, 5, 40, 200]) for _ in range(rng.randrange(12))]
        sums = [sum(weight[max(0, k - hx.WINDOW + 1) : k + 1]) for k in range(len(weight))]
        first, last = hx.stretch(weight)
        if not any(weight):
            assert (first, last) == (0, 0)
            continue
        high = [k for k, s in enumerate(sums) if s > min(hx.SURGE, hx.SHARE * max(sums))]
        assert weight[first] and weight[last - 1]
        assert high[0] - hx.WINDOW < first <= high[0] and high[-1] - hx.WINDOW < last - 1 <= high[-1]
        assert not any(weight[high[0] - hx.WINDOW + 1 : first]) if high[0] >= hx.WINDOW else not any(weight[:first])


class Plain(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on = self.on and tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_query_against_plain_reading(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_html_extract"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id].html)
        want = "\n\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b)
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


def test_nulls_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>word {k} of a long page</p>" for k in range(60_000)) + "</article>"
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, long, None, "y"), (4, "<p>a</p>" * 2, "x", None), (4, "<p>a</p>" * 2, "x", None)]
    table = spark.createDataFrame(rows, "id int, html string, text string, `a.b` string")
    done = hx.main_text(table).collect()
    assert done[0].row.asDict() == {"id": 1, "html": None, "text": "x", "a.b": "y"}
    assert [r.text for r in done if r.row.id != 3] == ["", "", "a\n\na", "a\n\na"]
    assert next(r.text for r in done if r.row.id == 3).count("\n\n") == 59_999
    assert hx.main_text(table.limit(0)).collect() == []


def test_time_grows_with_the_page():
    for part in ("<a href=\"x", "<div class='", "<!--", "<", "</", "<script>", "&#", "<p a=b c='d\"", "<li><ul>"):
        hx.extract(part * 100_000)
