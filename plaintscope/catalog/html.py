"""HTML extraction from stored pages and from pages rendered out of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaintscope.catalog import Tables, query
from plaintscope.functions import fixed_values as fv, html as H, page as P
from plaintscope.functions.fixed_values import TURKISH_MONTHS
from plaintscope.functions.scalars import absolute_url, resolution_status, safe_double, safe_int
from plaintscope.operators import scraped as S

WS = "[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+"
HIDDEN = "(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>"


def text_sql(html: str, sep: str) -> str:
    decoded = "p"
    for entity, char in fv.HTML_ENTITIES:
        decoded = "replace({}, '{}', '{}')".format(decoded, entity, char.replace("'", "''"))
    pieces = f"string_split_regex(regexp_replace({html}, '{HIDDEN}', '', 'g'), '<[^>]*>')"
    trimmed = f"list_transform({pieces}, lambda p: regexp_replace({decoded}, '^{WS}|{WS}$', '', 'g'))"
    return f"array_to_string(list_filter({trimmed}, lambda p: p <> ''), {sep})"


@query("x1_blocks", """
WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>') AS l FROM pages)
SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS block FROM b
""")
def x1_blocks(t: Tables):
    return S.explode_blocks(t.pages, "html", "p", keep=["page_id"])


@query("x2_text", f"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<h1\\b[^>]*>(.*?)</h1>') THEN {text_sql("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)", "''")} ELSE '' END AS title,
       CASE WHEN regexp_matches(html, '<div class="ad">') THEN {text_sql("regexp_extract(html, '(?s)<div class=.ad.[^>]*>(.*?)</div>', 1)", "''")} ELSE 'none' END AS ad
FROM pages
""")
def x2_text(t: Tables):
    return t.pages.select(
        "page_id", H.extract_text("html", "h1").alias("title"), H.extract_text("html", "div", "ad", "none").alias("ad")
    )


@query("x3_attr", """
SELECT page_id, regexp_extract(html, '(?s)<html\\b[^>]*\\blang="([^"]*)"', 1) AS lang,
       regexp_extract(html, '(?s)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS href,
       regexp_extract(html, '(?s)<article\\b[^>]*\\bdata-id="([^"]*)"', 1) AS id
FROM pages
""")
def x3_attr(t: Tables):
    return t.pages.select(
        "page_id", H.extract_attr("html", "html", "lang").alias("lang"),
        H.extract_attr("html", "a", "href").alias("href"), H.extract_attr("html", "article", "data-id").alias("id"),
    )


@query("x4_url", """
WITH h AS (SELECT page_id, regexp_extract(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1) AS href FROM pages)
SELECT page_id, CASE WHEN href <> '' THEN 'https://www.example.org' || href ELSE '' END AS url FROM h
""")
def x4_url(t: Tables):
    return t.pages.select("page_id", absolute_url(H.extract_attr("html", "a", "href"), "https://www.example.org").alias("url"))


# Counts are read from views as written, and from the others with a stray bracket.
@query("x5_safe_num", """
WITH r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN regexp_extract(props, '[0-9]+') ELSE regexp_extract(props, '[0-9]+.') END AS raw FROM events)
SELECT event_id, coalesce(try_cast(CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN raw END AS INTEGER), 0) AS count_value,
       try_cast(CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN raw END AS DOUBLE) AS rating
FROM r
""")
def x5_safe_num(t: Tables):
    raw = F.when(F.col("event_type") == "view", F.regexp_extract("props", "[0-9]+", 0)).otherwise(
        F.regexp_extract("props", "[0-9]+.", 0)
    )
    return t.events.select("event_id", safe_int(raw).alias("count_value"), safe_double(raw).alias("rating"))


@query("x6_tags", f"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1),
       lambda h: regexp_replace({text_sql('h', "''")}, '^#+', '')), ', ') AS tags
FROM pages
""")
def x6_tags(t: Tables):
    return t.pages.select("page_id", H.extract_tags("html", "li").alias("tags"))


@query("x7_strip", """
SELECT page_id, md5(regexp_replace(html, '(?s)<div class="ad"[^>]*>(.*?)</div>', '', 'g')) AS v FROM pages
""")
def x7_strip(t: Tables):
    return t.pages.select("page_id", F.md5(H.strip_elements("html", "div", "ad")).alias("v"))


@query("x8_text_lines", f"SELECT page_id, {text_sql('html', 'chr(10)')} AS v FROM pages")
def x8_text_lines(t: Tables):
    return t.pages.select("page_id", H.html_to_text("html", "\n").alias("v"))


@query("x9_status", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Çözülmedi' WHEN 'O' THEN 'Çözüldü'
       ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Bilinmiyor' ELSE 'Çözüldü' END END AS status
FROM orders
""")
def x9_status(t: Tables):
    badge = (
        F.when(F.col("o_orderstatus") == "F", "Bu konu Çözülmedi").when(F.col("o_orderstatus") == "O", "Çözüldü")
        .when(F.col("o_orderpriority") != "5-LOW", "Teşekkürler")
    )
    return t.orders.select("o_orderkey", resolution_status(badge).alias("status"))


@query("x10_fallback", f"""
WITH s AS (SELECT page_id,
  CASE WHEN regexp_matches(html, '<div class="brand-answer"') THEN 'answer' WHEN regexp_matches(html, '<div class="ad"') THEN 'ad' ELSE 'heading' END AS selector,
  CASE WHEN regexp_matches(html, '<div class="ad"') THEN regexp_extract(html, '(?s)<div class="ad"[^>]*>(.*?)</div>', 1)
       ELSE regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) END AS inner_html FROM pages)
SELECT page_id, selector, {text_sql('inner_html', "''")} AS text FROM s
""")
def x10_fallback(t: Tables):
    name, text = H.first_match("html", [("answer", "div", "brand-answer"), ("ad", "div", "ad"), ("heading", "h1", None)])
    return t.pages.select("page_id", name.alias("selector"), text.alias("text"))


CLASSED = "<[a-zA-Z][^>]*\\bclass=\"([^\"]*)\"[^>]*>([^<]*)"


@query("x11_classes", f"""
WITH v AS (SELECT regexp_replace(html, '{HIDDEN}', '', 'g') AS h FROM pages),
e AS (SELECT unnest(regexp_extract_all(h, '{CLASSED}', 1)) AS classes, unnest(regexp_extract_all(h, '{CLASSED}', 2)) AS inside FROM v),
c AS (SELECT unnest(list_distinct(string_split_regex(classes, '{WS}'))) AS class, {text_sql('inside', "''")} AS text FROM e)
SELECT class, count(*) AS elements, min(nullif(substr(text, 1, 60), '')) AS sample FROM c
WHERE class <> '' AND regexp_matches(class, 'ad|nav|text') GROUP BY class
""")
def x11_classes(t: Tables):
    return S.class_inventory(t.pages, "html", ["ad", "nav", "text"])


# Orders rendered with elements inside their own kind, in any case and quoting.
@query("x1_nested", """
SELECT o_orderkey, pos::INTEGER AS pos, [0, 1, 1, 2][pos + 1]::INTEGER AS depth,
       [o_orderstatus || o_orderpriority || o_custkey || 'end', o_orderstatus, o_orderpriority || o_custkey, o_custkey::VARCHAR][pos + 1] AS text,
       ['<DIV CLASS=''order box'' data-k="a>b"><div class=status>' || o_orderstatus || '</div><!-- </div> --><Div class="box" >' || o_orderpriority || '<br><div>' || o_custkey || '</div></DIV> end</DIV >',
        '<div class=status>' || o_orderstatus || '</div>', '<Div class="box" >' || o_orderpriority || '<br><div>' || o_custkey || '</div></DIV>', '<div>' || o_custkey || '</div>'][pos + 1] AS block
FROM orders, (SELECT unnest(range(4)) AS pos)
""")
def x1_nested(t: Tables):
    page = F.format_string(
        "<!DOCTYPE html><script>'<div>'</script><DIV CLASS='order box' data-k=\"a>b\"><div class=status>%s</div><!-- </div> --><Div class=\"box\" >%s<br>"
        "<div>%s</div></DIV> end</DIV ><p>tail", "o_orderstatus", "o_orderpriority", "o_custkey")
    return S.explode_elements(t.orders.select("o_orderkey", page.alias("html")), "html", P.Selector("div"), ["o_orderkey"])


# Texts written with named, decimal and hexadecimal references, in an attribute and as they are.
@query("x3_references", """
SELECT doc_id, md5(text) AS attribute, md5(text) AS text FROM documents
""")
def x3_references(t: Tables):
    written = F.col("text")
    for char, reference in (("&", "&amp;"), ("<", "&lt;"), ("'", "&#39;"), ("ü", "&uuml;"), ("é", "&#233;"), ("ß", "&#xDF;"), ("e", "&#x65;"), ("ñ", "&#XF1")):
        written = F.replace(written, F.lit(char), F.lit(reference + ("" if reference.endswith(";") else ";")))
    page = F.concat(F.lit("<a title=none><A data-x=1 TITLE='"), written, F.lit("'>x</a>"))
    lexed = t.texts().select("doc_id", written.alias("written"), P.parsed(page).alias("page"))
    link = P.first(F.col("page"), P.Selector("a", attribute=("data-x", "1")))
    return lexed.select("doc_id", F.md5(P.attribute(link, "title")).alias("attribute"), F.md5(H.decode_entities("written")).alias("text"))


# The first of four selectors that finds something: attribute, class of any tag, text in a set, words in the text.
@query("x10_selectors", """
SELECT o_orderkey, ['rating', 'answer', 'status', 'reply'][o_orderkey % 4 + 1] AS selector,
       CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Çözüldü' ELSE 'Firma YANIT verdi: ' || o_orderstatus END AS text
FROM orders
""")
def x10_selectors(t: Tables):
    k = F.col("o_orderkey") % 4
    part = (
        F.when(k == 0, F.format_string("<b itemprop=name>no</b><I ItemProp='ratingValue'>%s</I>", "o_custkey"))
        .when(k == 1, F.format_string("<aside class='x  brand-answer'>%s</aside>", "o_orderpriority"))
        .when(k == 2, F.lit("<b>Çözüldü mü</b><div> <b> Çözüldü </b> </div>"))
        .otherwise(F.format_string("<p>Firma YANIT verdi: %s", "o_orderstatus")))
    page = F.concat(F.lit("<!-- itemprop=ratingValue --><div class=brand-answers><br></div>"), part)
    lexed = t.orders.select("o_orderkey", P.parsed(page).alias("page"))
    name, text = P.first_of(F.col("page"), [
        ("rating", P.Selector(attribute=("itemprop", "ratingValue"))), ("answer", P.Selector(cls="brand-answer")),
        ("status", P.Selector(("span", "div", "b"), within=("Çözüldü", "Beklemede"))), ("reply", P.Selector(("div", "p"), saying=("cevap", "yanıt", "yanit")))])
    return lexed.select("o_orderkey", name.alias("selector"), text.alias("text"))


MONTHS = "[" + ", ".join(f"'{m}'" for m in TURKISH_MONTHS) + "]"


# Orders rendered as list pages of up to 24 cards, then parsed back.
@query("x13_list_cards", f"""
WITH o AS (SELECT *, o_orderkey // 24 AS page, row_number() OVER (PARTITION BY o_orderkey // 24 ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT page, pos::INTEGER AS pos, 'Op ' || page AS operator, o_orderkey::VARCHAR AS id,
       day(o_orderdate) || ' ' || {MONTHS}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' 10:00' AS date_raw,
       CAST(o_orderdate AS DATE) AS date, 'user' || o_custkey AS username, 'Order ' || o_orderkey || ' & more' AS title,
       o_orderpriority || ', ' || o_orderstatus AS keywords, 'Total of' AS description_preview,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey::INTEGER END AS view_count, (o_orderkey % 7)::INTEGER AS upvote_count,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'https://www.example.org/o/' || o_orderkey END AS url
FROM o
""")
def x13_list_cards(t: Tables):
    month = F.element_at(F.array(*[F.lit(m) for m in TURKISH_MONTHS]), F.month("o_orderdate"))
    title = F.format_string("Order %s &amp; more", "o_orderkey")
    href = F.format_string(' href="/o/%s"', "o_orderkey")
    link = F.when(F.col("o_orderstatus") == "F", "").otherwise(href)
    card = F.format_string(
        '<article class="card-v2 ga-v" data-id=" %s " data-upvoter-count="%s"><h2 class="complaint-title">'
        '<a%s>%s</a></h2><span class="username"> user%s </span><div class="js-tooltip post time">%s %s %s 10:00</div>'
        '<span class="count js-view-count">%s</span><a class="sv-model-button">#%s</a><a class="sv-model-button x">#%s </a>'
        '<p class="complaint-description short">Total of<span class="ellipsis-text">... more</span></p></article>',
        "o_orderkey", F.col("o_orderkey") % 7, link, title, "o_custkey",
        F.dayofmonth("o_orderdate"), month, F.year("o_orderdate"),
        F.when(F.col("o_orderstatus") == "P", "1.2K").otherwise(F.col("o_custkey").cast("string")),
        "o_orderpriority", "o_orderstatus",
    )
    pages = t.orders.groupBy(F.floor(F.col("o_orderkey") / 24).alias("page")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card"))))["card"], "\n").alias("html")
    ).withColumn("operator", F.concat(F.lit("Op "), F.col("page").cast("string")))
    today = F.lit("2026-01-01").cast("date")
    return S.list_cards(pages, "html", "operator", "https://www.example.org", today, keep=["page"])


# Documents rendered as detail pages; without a label there is no badge and no rating.
@query("x13_detail", """
SELECT doc_id::VARCHAR AS url, array_to_string(list_filter(list_transform(
         string_split(text, chr(10)), lambda p: regexp_replace(p, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+$', '', 'g')), lambda p: p <> ''), chr(10)) AS full_text,
       CASE WHEN toxic = 1 THEN 'Dear' || chr(10) || source ELSE '' END AS company_reply,
       CASE quality WHEN 1 THEN 'Çözüldü' WHEN 0 THEN 'Çözülmedi' ELSE 'Bilinmiyor' END AS is_resolved,
       CASE WHEN quality IS NOT NULL THEN quality + 0.5::DOUBLE END AS satisfaction
FROM documents LEFT JOIN labels USING (doc_id)
""")
def x13_detail(t: Tables):
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    reply = F.when(F.col("toxic") == 1, F.format_string('<div class="complaint-reply-container"><b>Dear</b> %s</div>', "source"))
    badge = F.when(F.col("quality").isNotNull(), F.format_string(
        '<div class="solved-badge ga-v">%s</div><span class="rate-num">%s.5</span>',
        F.when(F.col("quality") == 1, fv.RESOLVED).otherwise(fv.UNRESOLVED), F.col("quality"),
    ))
    html = F.concat(
        F.lit('<div class="complaint-detail-description">'), F.replace(escaped, F.lit("\n"), F.lit("<br>")), F.lit("</div>"),
        F.coalesce(reply, F.lit("")), F.coalesce(badge, F.lit("")),
    )
    docs = t.texts("source").join(t.labels, "doc_id", "left")
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), html.alias("html"))
    return S.detail_fields(pages, "html", "url")
