"""The page lexer, references and selectors."""

import html as references
import random
import re

import pytest
from pyspark.sql import functions as F

from plaintscope.functions import html as H, page as P
from plaintscope.operators import scraped as S


def told(page):
    """(tag, text, outer) of every element."""
    tags, places, texts = P.lex(page)
    return [(t.name, "|".join(texts[p[7]:p[7] + p[8]]), page[p[3]:p[4]]) for t, p in zip(tags, places)]


@pytest.mark.parametrize("page, want", [
    ("<DIV>a<div>b</DIV> c </div>d", [("div", "a|b|c", "<DIV>a<div>b</DIV> c </div>"), ("div", "b", "<div>b</DIV>")]),
    ("<p>one<p>two</p>three", [("p", "one", "<p>one"), ("p", "two", "<p>two</p>")]),
    ("<p>a<b>b<p>c", [("p", "a|b", "<p>a<b>b"), ("b", "b", "<b>b"), ("p", "c", "<p>c")]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("ul", "a|b|c", "<ul><li>a<ul><li>b</ul><li>c</ul>"), ("li", "a|b", "<li>a<ul><li>b</ul>"),
                                            ("ul", "b", "<ul><li>b</ul>"), ("li", "b", "<li>b"), ("li", "c", "<li>c")]),
    ("a<br>b<img src='x>y'/>c</i>", [("br", "", "<br>"), ("img", "", "<img src='x>y'/>")]),
    ("<script>if (a<b) '</p>'</script>x<!-- <p>no</p> --><style>p{}</style>", [("script", "", "<script>if (a<b) '</p>'</script>"), ("style", "", "<style>p{}</style>")]),
    ("<script>never ends <p>", [("script", "", "<script>never ends <p>")]),
    ("<a title='x", []), ("<a title='>b</a>", [("a", "b", "<a title='>b</a>")]), ("", []), ("1 < 2 > 1", []),
])
def test_elements(page, want):
    assert told(page) == want


def test_attributes():
    got = P.attributes_of(""" Class = "a &amp; b" ID='&#252;' href=/x?a=1&amp;b checked class=c data-é="1" """)
    assert got == {"class": "a & b", "id": "ü", "href": "/x?a=1&b", "checked": "", "data-é": "1"}


def test_every_element_holds_what_lies_in_it():
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "x", "<span a='>'>", "</span>", "</td>", "<td>"]) for _ in range(30))
        tags, places, texts = P.lex(page)
        for k, (at, inside, parent, start, stop, inner, inner_stop, first, count) in enumerate(places):
            assert at == k and 0 <= start < inner <= inner_stop <= stop <= len(page)
            assert [j for j, p in enumerate(places) if p[3] >= inner and p[4] <= inner_stop and j > k] == list(range(k + 1, k + 1 + inside))
            assert parent < k and (parent < 0 or places[parent][4] >= stop)
            assert "".join(texts[first:first + count]) == "x" * page[inner:inner_stop].count("x") or "x" not in page[inner:inner_stop]


def test_references(spark):
    texts = ["&uuml;&#252;&#xFC;&#XfC;", "&amp;lt;", "&unknown; &", "&#0;&#xD800;&#x110000;&#1114112;", "&#128;&#150;", "a&b;c&&amp;", "&#x1F642;x", "&#65 &#66b", "&apos;&nbsp;|", "",
             "plain", None, "&thetasym;&Alpha;", "&#999999999;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(H.decode_entities("t").alias("d")).collect()
    want = [None if t is None else references.unescape(t) for t in texts]
    assert [r.d for r in rows] == want


PAGE = """<HTML><body><section CLASS='box main'><div class="box"><div class='box inner' itemprop="ratingValue">4.5</div>deep</div> top
<SPAN>Çözüldü</SPAN></section><section>Marka cevabı burada</section><a HREF=/x?a=1&amp;b=2 data-k='"q"'>#one</a><a>#two</a></body>"""


def test_selectors(spark):
    lexed = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string").select("html", P.parsed("html").alias("p"))
    p = F.col("p")
    text = lambda **of: P.text_of(p, P.first(p, P.Selector(**of)), "|")
    rows = lexed.select(
        text(cls="box").alias("a"), text(tag="div", cls="inner").alias("b"), text(part=("box", "in")).alias("c"), text(attribute=("itemprop", "ratingValue")).alias("d"),
        text(tag=("span", "p"), within=("Çözüldü", "Beklemede")).alias("e"), text(tag="section", saying=("CEVAP", "BURADA")).alias("f"), text(attribute=("data-k", None)).alias("g"),
        text(tag="h1").alias("h"), P.attribute(P.first(p, P.Selector("a")), "href").alias("i"), P.tag_list(p, P.Selector("a")).alias("j"),
        P.text_without(p, P.first(p, P.Selector(cls="main")), P.every(p, P.Selector(cls="inner"))).alias("k"),
        P.outer("html", P.first(p, P.Selector(cls="inner"))).alias("l"), P.inner("html", P.first(p, P.Selector("span"))).alias("m"),
        *[c.alias(n) for c, n in zip(P.first_of(p, [("none", P.Selector(cls="x")), ("rate", P.Selector(attribute=("itemprop", "ratingValue")))]), "no")]).collect()
    assert tuple(rows[0]) == (
        "4.5|deep|top|Çözüldü", "4.5", "4.5|deep|top|Çözüldü", "4.5", "Çözüldü", "Marka cevabı burada", "#one", None, "/x?a=1&b=2", "one, two", "deeptopÇözüldü",
        """<div class='box inner' itemprop="ratingValue">4.5</div>""", "Çözüldü", "rate", "4.5")
    assert all(v in (None, "") for r in rows[1:] for v in r)


def test_nested_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "k int, html string")
    rows = S.explode_elements(pages, "html", P.Selector("div"), ["k"]).collect()
    assert [(r.k, r.pos, r.depth, r.text) for r in rows] == [(1, 0, 3, "4.5deep"), (1, 1, 4, "4.5")]
    assert rows[0].block.startswith('<div class="box">') and rows[0].block.endswith("deep</div>")


def test_a_long_page_takes_one_pass():
    page = "<div>" * 20_000 + "x" + "</div>" * 20_000
    tags, places, texts = P.lex(page)
    assert len(tags) == 20_000 and places[0][4] == len(page) and places[-1][8] == 1


def test_each_reference_is_decoded_once_and_as_html_says(spark, monkeypatch):
    text = "a&amp;lt;b &#x65;&#101; &notit; &bogus; &" * 200 + "".join(f"&#{k};" for k in range(900, 960))
    want = references.unescape(text)
    calls = []
    monkeypatch.setattr(P, "_REFERENCES", type(P._REFERENCES)())
    monkeypatch.setattr(P.references, "unescape", lambda t, plain=references.unescape: calls.append(t) or plain(t))
    assert P.unescape(text) == want
    assert len(calls) == len(set(calls)) < 80
    monkeypatch.undo()
    plain = text.replace("&notit;", "")  # the column decodes names with their semicolon only
    rows = spark.createDataFrame([(plain,), ("&amp;" * 1200 + "&lt;",), (None,)], "t string").select(H.decode_entities("t").alias("d")).collect()
    assert [r.d for r in rows] == [references.unescape(plain), "&" * 1200 + "<", None]


def test_markup_is_cut_as_by_trying_every_way():
    """The patterns never try again what they took; that must find the same markup as ones that do."""
    again = [re.compile(p.pattern.replace("]++", "]").replace("*+", "*"), p.flags) for p in (P._MARKUP, P._TAG)]
    assert all("*+" in p.pattern for p in (P._MARKUP, P._TAG))
    pick = random.Random(2)
    bits = ["<a x='", "'", '"', ">", "<", "</p>", "<p y=\"", "=", "<script>", "</script>", "<!-- ", "-->", "/>", " z ", "<style ", "</style >"]
    for _ in range(3000):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 14)))
        assert P._MARKUP.split(text) == again[0].split(text)
        assert [m.groups() for m in P._TAG.finditer(text)] == [m.groups() for m in again[1].finditer(text)]


def test_end_tags_in_and_out_of_order():
    html = "<div><b>x</b><i>y<u>z</i></u><p>1<p>2</div>end"
    tags, places, texts = P.lex(html)
    assert [t.name for t in tags] == ["div", "b", "i", "u", "p", "p"] and texts == ["x", "y", "z", "1", "2", "end"]
    assert [html[p[3]:p[4]] for p in places] == ["<div><b>x</b><i>y<u>z</i></u><p>1<p>2</div>", "<b>x</b>", "<i>y<u>z</i>", "<u>z", "<p>1", "<p>2"]
    assert [p[1] for p in places] == [5, 0, 1, 0, 0, 0] and [p[2] for p in places] == [-1, 0, 0, 2, 0, 0] and [p[8] for p in places] == [5, 1, 2, 1, 1, 1]
