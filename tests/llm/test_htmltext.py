"""Main text of hand-written pages of several hosts, of the given pages, and of broken ones."""

import html
import re

import pytest

from paddock.llm import htmltext

SHELL = """<!doctype html><html><head><title>T &amp; U</title><style>p > a {color: red}</style><script>if (1 < 2) document.write("<article><p>no</p></article>")</script></head>
<body class="has-sidebar no-menu"><header class="masthead"><a href=/>Home</a></header><nav><ul><li><a href=/a>A<li><a href=/b>B</ul></nav>
<div class="cookie-notice">We use cookies, a lot of them, on this and any other page that you may open, as ever so often.</div>
%s
<aside class=sidebar><h2>Most read</h2><p>Another story entirely with a rather long teaser text that goes on and on</p></aside>
<section id="comments"><h3>Comments</h3><article class="comment"><p>First! A very long reader comment that says much and adds little to the page at hand.</p></article></section>
<form action=/s><input name=q value=x><button>Search</button></form><footer>&copy; 2024 <p>Imprint</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", 1) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, `a.b` long")


def test_given_pages_whole(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in htmltext.page_texts(found).collect()}
    for r in found.collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_hosts_agree(spark):
    """A page whose article is shorter than the rest is read at the path that its host's other pages voted for."""
    long = "<div class='post-%d wide'><h1>Head &lt;%d&gt;</h1><div class=ad>Buy now</div><p>Some text of the\n  article, number&nbsp;%d.<p>And <b>mo</b>re of it, <a href=/x>linked</a> too.<ul><li>one<li>two</ul></div>"
    want = "Head <%d>\nSome text of the article, number %d.\nAnd more of it, linked too.\none\ntwo"
    rows = [(f"https://www.one.example/{k}", SHELL % (long % (k, k, k))) for k in range(12)]
    rows.append(("https://WWW.one.example:443/short", SHELL % "<div class='wide post-77'><p>Hi.</p></div><div class=unknown><p>A block without a telling name that is much longer than the article.</p></div>"))
    rows.append(("https://www.one.example/empty", SHELL % "<div class='wide post-78'></div>"))
    rows.append(("https://www.one.example/other", SHELL % "<main><p>Other layout of the same host.</p></main>"))
    rows += [(f"http://two.example/{k}", SHELL % f"<main><header><h1>Title {k}</h1></header><p>Text {k}</p><footer>by someone</footer></main>") for k in range(3)]
    rows.append(("http://three.example/", SHELL % "<td><table><tr><td>cell one<td>cell two<tr><td>last</table>"))
    got = {r.page_id: r.text for r in htmltext.page_texts(pages(spark, rows).repartition(3)).collect()}
    assert [got[k] for k in range(12)] == [want % (k, k) for k in range(12)]
    assert got[12] == "Hi." and got[13] == "" and got[14] == "Other layout of the same host."
    assert [got[k] for k in range(15, 18)] == [f"Title {k}\nText {k}" for k in range(3)]
    assert got[18] == "cell one\ncell two\nlast"


ODD = [
    None, "", "no tags at all", "<", "<p", "a < b <p>c", "<!-- open", "<article><p>open &amp &notanentity; &#x41;&#66;", "<script>never closed <p>x", "<div " + "x" * 5000 + "><p>long tag</div>",
    "<p title=\"a>b\">quoted</p>", "</div></p></html>", "<div hidden><p>unseen</p></div>", "<![CDATA[x]]><?php y ?>", "<a href='>" * 50, "<textarea><p>x</textarea>y<br>z",
]


@pytest.mark.parametrize("same_host", [True, False])
def test_broken_pages(spark, same_host):
    rows = [(None if k % 5 == 0 else "http://h/" if same_host else f"//h{k}/", h) for k, h in enumerate(ODD)]
    got = {r.page_id: r for r in htmltext.page_texts(pages(spark, rows + rows)).collect()}
    assert len(got) == 2 * len(ODD) and all(r.text is not None and r.n_chars == len(r.text) for r in got.values())
    assert got[0].text == got[1].text == "" and all(got[k].text == got[k + len(ODD)].text for k in range(len(ODD)))
    assert got[7].text == "open & ¬anentity; AB"
    assert htmltext.page_texts(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("names", "out"),
    [
        ("class='article-comments'", True), ("class='post-footer'", True), ("id=main-nav", True), ("class=siteHeader", True), ("class='page_header'", True), ("class='entry-header'", False), ("class='content sidebar-right'", False),
        ("class='no-sidebar wide'", False), ("class='main-content' id=ad-1", False), ("class='ad ad--top'", True), ("class='shadow gradient'", False), ("role=complementary", True), ("class='cookie-notice'", True), ("class=readerComments", True), ("class='' id=''", False),
    ],
)
def test_names_of_boilerplate(names, out):
    assert htmltext.described("div", " " + names)[0] == out


def test_long_and_deep_pages():
    """Time and memory in proportion to the page."""
    deep = htmltext.Page("<div>" * 50_000 + "<p>end" + "</div>" * 50_000)
    assert deep.blocks == ["end"] and len(deep.at(deep.path(deep.best()))) == 1
    wide = htmltext.Page("<body>" + "<div><p>text of a block &amp; more</p></div>" * 100_000)
    assert len(wide.blocks) == 100_000 and wide.path(wide.best()) == "body"
    assert wide.under(wide.at("body")).count("\n") == 99_999


def test_winners_by_share(spark):
    make = lambda tag, n: [("http://h/", f"<body><{tag}><p>{'text ' * 9}</p></{tag}></body>")] * n
    got = htmltext.host_paths(pages(spark, make("main", 30) + make("article", 30) + make("section", 5) + [("http://h/", "")] * 90)).collect()
    assert [r.asDict() for r in got] == [{"host": "h", "winners": ["body/article", "body/main"]}]
