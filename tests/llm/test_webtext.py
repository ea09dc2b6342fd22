"""Main text of pages: kinds of page furniture, broken markup, and the given pages against another reader."""
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rowproof.llm import webtext
from rowproof.llm.base import prepare, table

P = "This is a long paragraph, with commas, and enough words to count as a real piece of prose for a reader."
Q = "Another paragraph stands here, also long enough, and says something else about the same matter at hand."


class Articles(HTMLParser):
    """Text of article elements, a block per h1 or p: right for pages whose only furniture lies outside the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [[]] if tag in ("p", "h1") else []
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [[]] if tag in ("p", "h1") else []

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)

    def text(self):
        self.close()
        return "\n\n".join(b for b in (" ".join("".join(b).split()) for b in self.blocks) if b)


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {}
    for r in pages.collect():
        reader = Articles()
        reader.feed(r.html or "")
        want[r.page_id] = (r.url, reader.text())
    got = webtext.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just text &amp; more < 3 <", "just text & more < 3 <"), ("<nav>a</nav><footer>b</footer>", ""),
    (f"<body class='has-sidebar'><div id=header><h1>Site</h1><p>{P}</p></div><div class='main-menu'><a href=x>Home</a></div>"
     f"<div class='content with-sidebar'><h2>Title</h2><p>{P}</p><p>Short.</p><div class='ad-box'>Buy, buy, buy</div><p>{Q}</p></div>"
     f"<div id=sidebar>{P}</div><div class='reader-comments'><p>{P}</p><p>{P}</p><p>{P}</p></div><div class='cookieNotice'>{P}</div>",
     f"Title\n\n{P}\n\nShort.\n\n{Q}"),
    (f"<main><article><header><h1>T</h1><p class=byline>By me</p></header><section><p>{P}</p></section><section><p>Tiny</p></section>"
     f"<footer>x</footer><section id=comments><article><p>{P}{P}</p></article></section></article></main><aside>{P}</aside>", f"T\n\n{P}\n\nTiny"),
    (f"<div class='header-fixed menu'><article><p>{P}</p></article></div>", P),
    (f"<ul><li><a href=1>Home</a><li><a href=2>Other</a></ul><p>{P}</p><p>ok</p><form><p>{Q}</p></form>", f"{P}\n\nok"),
    (f"<div class=post><p>{P}</p><p>{Q}</p></div><div class=post><p>{Q}</p></div><div><a href=1>one thing</a> <a href=2>two</a></div>",
     f"{P}\n\n{Q}\n\n{Q}"),
    (f"<article><p>{P}</p><ol><li>first<li>second</ol><ul class=share><li>x</ul><script>'<p>no</p>'</script><style>p{{}}</style>"
     "<table><tr><td>a<td>b<tr><td>c</table>text <b>bo</b>ld<br>next</article>", f"{P}\n\nfirst\n\nsecond\n\na\n\nb\n\nc\n\ntext bold next"),
    ("<p>a<!-- x > y -->b</p><!-- never ends <p>q</p>", "ab"), ("<p>a <p class=\"x>lost", "a"),
    ("<article><p><b>One<br><p>Two &eacute;&#x1F642;&nbsp;&nbsp;x\t\n y&copy</article>", "One\n\nTwo é🙂 x y©"),
    ("<article><p hidden>x<p aria-hidden=true>z<p title=\"a > b\">y</article>", "y"),
    ("<TITLE>t</TITLE><ARTICLE><H1>H</H1><P>x</P></ARTICLE>", "H\n\nx"),
])
def test_kinds_of_pages(html, text):
    assert webtext.main_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 50000 + "x", "<b>" * 50000 + "<p>x" * 1000, "<a href=\"" * 30000, "<p>x</div>" * 30000, "<" * 100000,
                                  "<!--" * 50000, "&amp" * 50000, "<td>" * 50000, "<li>" * 50000, "<table><tr><td>" * 20000 + "x"])
def test_hostile_pages_take_time_in_proportion(html):
    began = time.time()
    webtext.main_text(html)
    assert time.time() - began < 10


def test_long_page_is_read_whole():
    blocks = [f"{P} {i}" for i in range(20000)]
    assert webtext.main_text("<nav>x</nav><article><p>" + "</p><p>".join(blocks) + "</p></article>") == "\n\n".join(blocks)


def test_rows(spark):
    ddl = "page_id bigint, url string, html string, text string, n_chars bigint"
    rows = [(1, "u", "<p>x</p>", "clash", 9), (1, None, None, None, None), (None, "v", "", "", 0), (1, "u", "<p>x</p>", "again", 9)]
    prepare(spark)
    got = webtext.extract(spark.createDataFrame(rows, ddl))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "x", 1), (1, None, "", 0), (None, "v", "", 0), (1, "u", "x", 1)], key=repr)
    assert webtext.extract(spark.createDataFrame(rows, ddl).where(F.lit(False))).collect() == []
