"""HTML extraction: the parser, the decoding against all choices, layouts that were not trained on, odd pages."""

import itertools
import os
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from pathlake.llm import html_extract as hx
from pathlake.llm.dom import parse


def text_of(html):
    return [t for _, t in parse(html)[1]]


def test_parser():
    assert text_of("<p>a<p>b<br>c</p>d<ul><li>e<li>f</ul>") == ["a", "b c", "d", "e", "f"]
    assert text_of("<div>x <b>y</b>  z&amp;&eacute;&#33;</div>tail") == ["x y z&é!", "tail"]
    assert text_of("<script>var t='</p>'</script><style>p{}</style><!-- <p>no --><p>yes") == ["yes"]
    assert text_of("<p>1 < 2 & 3 </ p> <q>w</q>") == ["1 < 2 & 3 w"]
    assert text_of('<p title="a>b">c</p><?x?><!DOCTYPE html>') == ["c"]
    assert text_of("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert text_of("<p><b>a<p>b</b></p></div>c") == ["a", "b", "c"]
    assert text_of("") == [] and text_of("plain") == ["plain"] and text_of("<p") == [] and text_of("<!--") == []
    assert len(text_of("<div>" * 3000 + "deep")) == 1


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(1)
    for _ in range(60):
        html, open_ = "", 0
        for _ in range(7):
            if open_ and rng.random() < 0.4:
                html, open_ = html + "</div>", open_ - 1
            else:
                html, open_ = html + "<div>t", open_ + 1
        nodes, _ = parse(html)
        m = np.random.default_rng(rng.randrange(99)).normal(size=len(nodes))
        keep = hx.decode(nodes, m)
        best = -1e9
        for choice in itertools.product([False, True], repeat=len(nodes) - 1):
            c = (True, *choice)
            if all(c[x.parent.number] or not c[x.number] for x in nodes[1:]):
                best = max(best, sum(m[i] for i in range(1, len(nodes)) if c[i]))
        assert all(keep[x.parent.number] or not keep[x.number] for x in nodes[1:])
        assert abs(sum(m[i] for i in range(1, len(nodes)) if keep[i]) - best) < 1e-9


def test_pages_that_were_not_trained_on():
    """Pages of the training layouts from another seed."""
    rng, right, total = random.Random(12345), 0, 0
    for _ in range(120):
        html = hx._page(rng)
        nodes, blocks = parse(html)
        keep = hx.decode(nodes, hx.model().margin([(nodes, len(html))]))
        right += sum(keep[x.number] == ("data-y" in x.attrs) for x, _ in blocks)
        total += len(blocks)
    assert right / total > 0.98


ONE = "The council met on Monday to talk about the old bridge and what to do with it. Several members said that it should be kept."
TWO = "Others wanted it gone, because repairs cost more each year than the town takes in fees. No vote was held."
THREE = "A second meeting is planned for the autumn, when the report on the bridge is due."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li><li><a href="/d">Weather</a></li></ul>'
#: Pages written by hand, in ways that the training pages do not have.
LAYOUTS = {
    "one form": f'<form method="post" action="./p.aspx" id="aspnetForm"><div><input type="hidden" name="__VIEWSTATE" value="abc"></div><div id="header"><a href="/">Site</a></div><div id="nav">{MENU}</div><div id="ctl00_content"><h1>The bridge</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div><div id="footer">Copyright 2020 the paper. All rights reserved.</div></form>',
    "table": f"<table width=100%><tr><td width=120>{MENU}</td><td><h1>The bridge</h1><p>{ONE}<p>{TWO}<p>{THREE}</td></tr></table>",
    "blog": f'<div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My blog</a></p><nav class="main-navigation">{MENU}</nav></header><div class="site-content"><main id="main"><article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">The bridge</h1></header><div class="entry-content"><p>{ONE}</p><p>{TWO}</p><div class="sharedaddy share"><ul><li><a href="#">Tweet</a></li><li><a href="#">Mail</a></li></ul></div><p>{THREE}</p></div></article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I have walked over that bridge for years and would miss it very much, to be honest.</p></li></ol></div></main><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2>{MENU}</section></aside></div><footer id="colophon" class="site-footer"><p>Made with care by some people in a town.</p></footer></div>',
    "nothing else": f"<h1>The bridge</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>",
    "plain divs": f'<div class="wrap"><div class="top"><a href="/">Home</a> | <a href="/n">News</a> | <a href="/s">Sport</a></div><div class="cookie-notice"><p>We use cookies to make the site better for you. Do you agree?</p></div><div class="x1"><div class="x2"><h1>The bridge</h1><div>{ONE}</div><div>{TWO}</div><div>{THREE}</div></div></div><div class="bottom"><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></div>',
    "newspaper": f'<div id="app"><nav role="navigation">{MENU}</nav><div class="advertisement">Buy two boats, get one free, this week only.</div><section class="story"><h1>The bridge</h1><p>{ONE}</p><aside class="related"><h3>Read more</h3><p><a href="/z">Another bridge falls down in the north</a></p></aside><p>{TWO}</p><blockquote><p>{THREE}</p></blockquote></section><section class="newsletter"><h3>Sign up</h3><p>Get all the news of the town in your mail each day.</p><form><input name=m><button>Go</button></form></section><footer><p>The paper is made by the town and printed far away.</p></footer></div>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_that_were_not_trained_on(name):
    got = hx.extract(f"<!DOCTYPE html><html><head><title>x</title></head><body>{LAYOUTS[name]}</body></html>")
    assert got == "\n\n".join(["The bridge", ONE, TWO, THREE])


def around(inner, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{before}<article><h1>The bridge</h1><p>{ONE}</p>{inner}<p>{TWO}</p><p>{THREE}</p></article>{after}</body></html>"


#: What stands in an article or around it, and the blocks that it adds to the article's text.
PARTS = {
    "formula": ("<p>We know that <math><mi>x</mi><mo>=</mo><mn>42</mn></math> holds.</p>", ["We know that x=42 holds."]),
    "no script": (f"<noscript><p>{THREE} Again.</p></noscript>", [f"{THREE} Again."]),
    "object": (f"<object data=x><p>{THREE} Again.</p></object>", [f"{THREE} Again."]),
    "short pre": ("<pre>make all</pre>", ["make all"]),
    "xmp": ("<xmp>x = 1 and y</xmp>", ["x = 1 and y"]),
    "address": ("<address>Town hall, Main street 1</address>", ["Town hall, Main street 1"]),
    "one link": ('<p><a href="/r">Read the whole report on the bridge here</a></p>', ["Read the whole report on the bridge here"]),
    "two links": ('<p>See these:</p><ul><li><a href="/r">The report</a></li><li><a href="/s">The plan</a></li></ul>', ["See these:", "The report", "The plan"]),
    "inline advert": (f"<p>{THREE} <span class=ad>Buy a boat now!</span> Again.</p>", [f"{THREE} Again."]),
    "inline term": (f"<p>{THREE} <span class=term>Ferry</span> again.</p>", [f"{THREE} Ferry again."]),
    "character data": (f"<p>{THREE} <![CDATA[ a > b ]]> Again.</p>", [f"{THREE} Again."]),
    "form controls": (f"<p>{THREE} <select><option>a<option>b</select><textarea>c</textarea> Again.</p>", [f"{THREE} Again."]),
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_of_an_article(name):
    inner, blocks = PARTS[name]
    assert hx.extract(around(inner)).split("\n\n") == ["The bridge", ONE, *blocks, TWO, THREE]


@pytest.mark.parametrize(("before", "after"), [("Menu | Home | About | Login ", ""), ("", "<div role=contentinfo>Made by the town press, all rights are reserved.</div>"), ("<noscript>Please turn on scripts to see this.</noscript>", "&copy; the paper")])
def test_what_stands_around_an_article(before, after):
    assert hx.extract(around("", before, after)).split("\n\n") == ["The bridge", ONE, TWO, THREE]


def test_text_outside_of_any_element():
    assert hx.extract(f"Menu | Home | About | Login<article><h1>The bridge</h1><p>{ONE}</p><p>{TWO}</p></article><footer>x y</footer>").split("\n\n") == ["The bridge", ONE, TWO]


def test_other_kinds_of_pages():
    sentences = [s + "." for s in f"{ONE} {TWO} {THREE}"[:-1].split(". ")]
    divs = "".join(f"<div>{s}</div>" for s in sentences)
    assert hx.extract(f"<html><body><div id=content><h1>The bridge</h1>{divs}</div></body></html>").split("\n\n") == ["The bridge", *sentences]
    names = [f"Bridge number {i}" for i in range(8)]
    page = f"<body><nav>{MENU}</nav><main><h1>All bridges</h1><ul>{''.join(f'<li><a href=/{i}>{x}</a></li>' for i, x in enumerate(names))}</ul></main><footer>Copyright</footer>"
    assert hx.extract(page).split("\n\n") == ["All bridges", *names]
    cited = '<h2>References</h2><ol class="references"><li id="cite_note-1"><span class="mw-cite-backlink"><a href="#a">^</a></span> <span class="reference-text">Smith, J. Bridges of the north.</span></li><li id="cite_note-2"><span class="reference-text">Doe, A. More bridges.</span></li></ol>'
    got = hx.extract(f'<body><div id="mw-content-text"><h1>The bridge</h1><p>{ONE}</p><p>{TWO}</p>{cited}</div></body>').split("\n\n")
    assert got[:3] == ["The bridge", ONE, TWO] and "Smith, J. Bridges of the north." in got[-2] and got[-1] == "Doe, A. More bridges."


def test_runs_and_named_inline_elements_are_nodes():
    nodes, blocks = parse("<div>a<p>b <span class=x>c <i>d</i></span> e</p>f</div><p>g</p>")
    assert [n.tag for n in nodes] == ["#root", "div", "#text", "p", "span", "#text", "p"] and all(n.number == i and (i == 0 or n.parent.number < i) for i, n in enumerate(nodes))
    assert [(x.tag, t) for x, t in blocks] == [("#text", "a"), ("p", "b c d e"), ("#text", "f"), ("p", "g")] and [n.own for n in nodes] == [0, 0, 1, 2, 2, 1, 1]


def test_query_equals_brute_force(spark):
    """The tables' pages have one layout, in which a regular expression finds the article: the query must give exactly its text."""
    from pathlake.llm.queries import op8_html_extract

    at = "/root/testdata/sf0.001"
    if not os.path.exists(f"{at}/pages.parquet"):
        pytest.skip("no tables here")

    def article(html):
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        return "\n\n".join(x for x in blocks if x)

    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op8_html_extract(spark, at).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_parsing_takes_time_in_proportion():
    """Deep nesting, open inline elements, quotes that never close, list items under deep elements: 5 times the input in well under 25 times the time."""
    for make in (lambda n: "<div>" * n + "deep", lambda n: "<b>" * n + "x<i>y</i>" * n, lambda n: "<p a='" + '<a t=">' * n, lambda n: "<ul><li>" + "<div>" * n + "<li></li>" * n, lambda n: "<p>" + "<div>x</div>" * n):
        taken = []
        for n in (8_000, 40_000):
            html, began = make(n), time.perf_counter()
            parse(html)
            taken.append(time.perf_counter() - began)
        assert taken[1] < 15 * max(taken[0], 0.02)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies, more than you think.</p></div><div class="ad">Buy a boat now.</div><article><h1>Title &amp; more</h1><p>First paragraph of the story,
with  a line break.<br>And more of it here.</p><div class="ad">Another ad.</div><p>Second one.</p></article><aside class="sidebar"><p>Related words.</p></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thank you very much for it.</p></div></section><form><p>Search</p><input></form><footer>&copy; someone</footer></body></html>"""


def test_a_page():
    assert hx.extract(PAGE) == "Title & more\n\nFirst paragraph of the story, with a line break. And more of it here.\n\nSecond one."


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", None), (4, "w", "<article>" + "<p>word " * 20_000, None)]
    got = hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and by[1].startswith("Title & more") and by[2] == by[3] == "" and by[4].count("word") == 20_000
    assert hx.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_letters_whose_lower_case_is_longer():
    for tag in ("script", "STYLE", "Button"):
        html = f"<p>{'İ' * 40}<{tag}>x</{tag.swapcase()}>seen <b>too</b> and all of this</p><p>end"
        assert text_of(html) == [f"{'İ' * 40} seen too and all of this", "end"]


def test_sibling_features_at_any_number():
    for n in (10, 63, 64, 150):
        html = "<article>" + "".join(f"<{t}>words</{t}>" for t in ["h2" if i % 5 == 0 else "p" for i in range(n)]) + "</article>"
        nodes, _ = parse(html)
        x = hx.node_features(nodes, len(html), np.zeros(hx.SLOTS))[2:]
        heads = -(-n // 5)
        assert np.allclose(x[:, -6], np.arange(n) / n) and set(x[:, -5]) == {n}
        assert x[:, -4].tolist() == [heads if i % 5 == 0 else n - heads for i in range(n)]
