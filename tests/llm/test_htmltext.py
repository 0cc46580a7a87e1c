"""Extraction on pages whose article is known, and on odd markup."""

import html
import re
import tracemalloc

import pytest

from hashsieve.llm import htmltext as H
from tests.conftest import SF01

ARTICLE = "<h1>A title</h1><p>First paragraph, with some text in it. And more.</p><p>Be.</p><p>Third &amp; last, still text.</p>"
WANT = "A title\nFirst paragraph, with some text in it. And more.\nBe.\nThird & last, still text."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("body", [
    f"<article>{ARTICLE}</article>",
    f"<nav><ul><li><a href=x>Home</a></li></ul></nav><main>{ARTICLE}</main><footer>&copy; x, all rights. Really.</footer>",
    f"<header><h2>Site</h2></header><article><header>{ARTICLE[:16]}</header>{ARTICLE[16:]}</article><aside><p>Other news, here.</p></aside>",
    f"<div class='cookie-notice'><p>We use cookies, of course.</p></div><div id=content>{ARTICLE}</div><div class=ad>Buy. Now.</div>",
    f"<article>{ARTICLE}<section class='comments'><p>Nice article, I liked it a lot. Thanks!</p></section></article>",
    f"<div role=banner>Top, of page.</div><article>{ARTICLE}<form><label>Mail</label><input><button>Go</button></form></article>",
    f"<article><!-- <p>old</p> -->{ARTICLE}<noscript><p>Enable it.</p></noscript><template><p>x</p></template></article>",
    f"<article class='post no-sidebar'>{ARTICLE}</article><div class='sidebar'><p>Some text, in the sidebar. With stops.</p></div>",
])
def test_article_without_the_rest(body):
    assert H.extract(page(body)) == WANT


@pytest.mark.parametrize("wrapper", ["div class='layout right-sidebar'", "div class='content-with-sidebar'", "div class=print", "div id=widget", "form id=aspnetForm"])
@pytest.mark.parametrize("inner", ["article", "div class=text"])
def test_wrapper_named_like_boilerplate(wrapper, inner):
    rest = "<nav><a href=x>Home</a></nav><div class=sidebar><p>Some text, aside.</p></div><div class=share>Share. It.</div>"
    ends = inner.split()[0], wrapper.split()[0]
    assert H.extract(page(f"<{wrapper}>{rest}<{inner}>{ARTICLE}</{ends[0]}></{ends[1]}><footer>Legal, all of it.</footer>")) == WANT


def test_boilerplate_around_and_beside_articles():
    teaser = "<article class=card><p>Another article, in short. Read on.</p></article>"
    long = "<p>A remark on it, not a short one. With stops, and more.</p>" * 9
    outside = f"<div><p>{'Unlisted words without end ' * 9}</p></div>"
    assert H.extract(page(f"<main>{ARTICLE}</main><div class=related>{teaser}</div>")) == WANT
    assert H.extract(page(f"<article>{ARTICLE}<aside>{teaser}</aside></article>")) == WANT
    assert WANT in H.extract(page(f"<div class='layout right-sidebar'><article>{ARTICLE}</article></div>{outside}"))
    assert H.extract(page(f"<div id=text>{ARTICLE}</div><div class=comments>{long[:len(long) // 9 * 4]}</div>")) == WANT
    assert H.extract(page("<nav><a href=x>Home</a></nav><footer>Legal, all of it.</footer>")) == ""
    parts = [f"<div class={c}><p>Part of the text, no. {c}.</p></div>" for c in ("widget", "print", "promo")]
    assert H.extract(page("".join(parts))) != ""


LINKED = ARTICLE.replace("A title", "<a href=x>A title</a>") + "<h2>Sources</h2><ul><li><a href=a>One source</a><li><a href=b>Other source</a></ul>"


@pytest.mark.parametrize("body", [
    f"<article>{LINKED}</article>",
    f"<article><section><h1><a href=x>A title</a></h1></section><section>{LINKED[LINKED.index('<p>'):]}</section></article>",
    f"<ul><li><a href=x>Home</a><li><a href=y>Other pages</a></ul><article>{LINKED}</article>",
    f"<div id=content>{LINKED}</div>",
])
def test_linked_blocks_of_the_article(body):
    assert H.extract(page(body)) == WANT + "\nSources\nOne source\nOther source"


def test_link_lists_alone_are_no_text():
    links = "<ul><li><a href=x>One page</a><li><a href=y>Other page</a></ul>"
    assert H.extract(page(links)) == H.extract(page(f"<main>{links}</main>")) == ""
    assert H.extract(page(f"{links}<h1><a href=x>A title</a></h1>{ARTICLE[16:]}")) == WANT


def test_every_article_of_the_page():
    second = "<article class=two><p>The second article, with less of it. But all of it.</p></article>"
    got = H.extract(page(f"<div id=all><article class=one>{ARTICLE}</article>{second}</div><nav><a href=x>Home</a></nav>"))
    assert got == WANT + "\nThe second article, with less of it. But all of it."


def test_inline_markup_and_white_space():
    assert H.extract("<p>a <b>bold</b>\n\t word<br>next&nbsp;x<p>two<ul><li>one<li>two</ul>") == "a bold word next x\ntwo\none\ntwo"


@pytest.mark.parametrize("attribute", ["title=don't", 'title=5">'[:-1], "title='a>b'", "a=", "=x", "data-x = \"it's\"", "title=\"<p>\" title='two'", "'", "a/b='c'/"])
def test_attributes_with_stray_quotes(attribute):
    assert H.extract(page(f"<article>{ARTICLE.replace('<p>', f'<p {attribute}>', 2)}</article><nav {attribute}><a href=x>Home</a></nav>")) == WANT


def test_attributes():
    assert H._attributes(" class=a CLASS=b hidden data-x='1>2' y=\"&amp;'\" z=don't q= /") == {
        "class": "a", "hidden": "", "data-x": "1>2", "y": "&'", "z": "don't", "q": "/"}
    assert H.extract(page(f"<article>{ARTICLE}</article><p hidden>Not shown, at all.</p><p title='not hidden in'></p>")) == WANT
    assert H.extract(page(f"<article>{ARTICLE.replace('<p>', '<p title=\'is hidden here\'>')}</article>")) == WANT


def test_formulas_pictures_and_fallbacks_are_text():
    got = H.extract("<article><p>Let <math>x=2</math> be given, <svg><style>a{}</style><text>seen</text></svg> too.</p><object data=x><p>Fallback, as text.</p></object></article>")
    assert got == "Let x=2 be given, seen too.\nFallback, as text."


def test_deep_pages():
    deep = "<article>" + "<div class=row-of-items>x, y. " * 6000
    tracemalloc.start()
    assert H.extract(deep) == "\n".join(["x, y."] * 6000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_edges(spark):
    assert H.extract(None) == H.extract("") == H.extract("<html><body></body></html>") == H.extract("<script>x") == ""
    assert H.extract("plain text, no tags") == "plain text, no tags"
    assert H.extract("<p>1 &lt; 2 &amp;amp; 3 <unclosed") == "1 < 2 &amp; 3"
    long = "<article>" + "<p>word, and more.</p>" * 50_000 + "</article>"
    assert H.extract(long).count("\n") == 49_999
    df = spark.createDataFrame([(1, "u", long, 1), (2, None, None, 2), (2, None, None, 2), (None, "x", "<p>t</p>", 3)], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in H.main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", H.extract(long), len(H.extract(long))), (2, None, "", 0), (2, None, "", 0), (None, "x", "t", 1)], key=str)
    assert H.main_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The table's pages hold their article in one element; its blocks end at p, h1 and br."""
    got = {r.page_id: r.text for r in H.main_text(spark.read.parquet(f"{SF01}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF01}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"[ \t\n\r\f]+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner))
        assert got[r.page_id] == "\n".join(p for p in parts if p)
