"""Complaint rows from stored pages: list cards, detail fields, page inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.functions import fixed_values as fv
from plaintscope.functions import html as H, page as P
from plaintscope.functions.dates import parse_tr_date
from plaintscope.functions.scalars import absolute_url, resolution_status, safe_double, safe_int
from plaintscope.functions.text import WS, evaluate_once, strip


def explode_blocks(pages: DataFrame, html: str, tag: str, cls: str | None = None, keep: list[str] = ()) -> DataFrame:
    """One row per matching element with its place on the page (from 0)."""
    return pages.select(*keep, F.posexplode(H.blocks(html, tag, cls)).alias("pos", "block"))


def explode_elements(pages: DataFrame, html: str, selector: P.Selector, keep: list[str] = ()) -> DataFrame:
    """One row per matching element, nested ones too: place on the page (from 0), how many
    elements it lies in, the element as it stands in the page, and its text.

    Pages are lexed once; elements may hold their own kind and be written in any case."""
    lexed = pages.select(*keep, F.col(html).alias("__html"), P.parsed(html).alias("__page"))

    def told(page: Column) -> Column:
        depth = lambda e: F.size(F.filter(page["elements"], lambda o: (o["at"] < e["at"]) & (o["at"] + o["inside"] >= e["at"])))
        return F.transform(P.every(page, selector), lambda e: F.struct(
            depth(e).alias("depth"), P.outer("__html", e).alias("block"), P.text_of(page, e).alias("text")))

    return lexed.select(*keep, F.posexplode(evaluate_once(F.col("__page"), told)).alias("pos", "e")).select(*keep, "pos", "e.*")


def list_cards(pages: DataFrame, html: str, operator: str, root: str, today: Column, keep: list[str] = ()) -> DataFrame:
    """Complaint cards of list pages as typed rows. A page is lexed once; each card reads its
    fields from the elements inside it."""
    lexed = pages.select(*keep, operator, P.parsed(html).alias("__page"))

    def fields(page: Column, card: Column) -> Column:
        text = lambda selector: evaluate_once(P.first(page, selector, card), lambda e: F.coalesce(P.text_of(page, e), F.lit("")))

        def titled(head: Column) -> Column:
            link = P.first(page, P.Selector("a"), head)
            return evaluate_once(link, lambda a: F.struct(
                F.coalesce(P.text_of(page, a), P.text_of(page, head), F.lit("")).alias("title"), P.attribute(a, "href").alias("href")))

        def shortened(preview: Column) -> Column:
            noise = P.every(page, P.Selector("span", fv.CARD_PREVIEW_NOISE), preview)
            return F.coalesce(P.text_without(page, preview, noise), F.lit(""))

        previews = [P.first(page, P.Selector(tag, part=fv.CARD_PREVIEW), card) for tag in ("p", "a")]
        return F.struct(
            strip(F.coalesce(P.attribute(card, "data-id"), F.lit(""))).alias("id"),
            text(P.Selector("div", part=fv.CARD_TIME)).alias("date_raw"),
            text(P.Selector("span", fv.CARD_USER)).alias("username"),
            evaluate_once(P.first(page, P.Selector("h2", fv.CARD_TITLE), card), titled).alias("head"),
            P.tag_list(page, P.Selector("a", part=fv.CARD_KEYWORD), card).alias("keywords"),
            evaluate_once(F.coalesce(*previews), shortened).alias("description_preview"),
            text(P.Selector("span", part=fv.CARD_VIEWS)).alias("views"),
            P.attribute(card, "data-upvoter-count").alias("upvotes"),
        )

    def cards(page: Column) -> Column:
        return F.transform(P.every(page, P.Selector("article", part=fv.CARD)), lambda card: fields(page, card))

    rows = lexed.select(*keep, operator, F.posexplode(evaluate_once(F.col("__page"), cards)).alias("pos", "card"))
    card = F.col("card")
    return rows.select(
        *keep, "pos", F.col(operator).alias("operator"), card["id"].alias("id"), card["date_raw"].alias("date_raw"), card["username"].alias("username"),
        card["head"]["title"].alias("title"), card["keywords"].alias("keywords"), card["description_preview"].alias("description_preview"),
        safe_int(card["views"]).alias("view_count"), safe_int(card["upvotes"]).alias("upvote_count"),
        absolute_url(F.coalesce(card["head"]["href"], F.lit("")), root).alias("url"), parse_tr_date(card["date_raw"], today).alias("date"))


def detail_fields(pages: DataFrame, html: str, url: str) -> DataFrame:
    """Full text, reply, status and rating of detail pages, from one lexer pass."""
    lexed = pages.select(F.col(url).alias("url"), P.parsed(html).alias("__page"))
    page = F.col("__page")

    def text(sep: str, **of) -> Column:
        return evaluate_once(P.first(page, P.Selector(**of)), lambda e: P.text_of(page, e, sep))

    return lexed.select(
        "url",
        F.coalesce(text("\n", cls=fv.DETAIL_TEXT), F.lit("")).alias("full_text"),
        F.coalesce(text("\n", cls=fv.DETAIL_REPLY), F.lit("")).alias("company_reply"),
        resolution_status(text("", part=fv.DETAIL_BADGE)).alias("is_resolved"),
        safe_double(text("", cls=fv.DETAIL_RATING)).alias("satisfaction"),
    )


def enrich(rows: DataFrame, detail: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of detail fields; rows without detail get the defaults.

    Each row takes one detail: of several for a key, the least in order of all fields. Blank
    and null keys have none, and their rows take no part in the join.
    """
    fields = [c for c in detail.columns if c != key]
    known = F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")
    one = detail.filter(known).groupBy(key).agg(F.min(F.struct(*fields)).alias("__one")).select(key, "__one.*")
    rows = rows.drop(*fields)
    found = rows.filter(known).join(one, key, "left")
    joined = found.unionByName(rows.filter(~F.coalesce(known, F.lit(False))), allowMissingColumns=True)
    return joined.select(
        *[c for c in rows.columns if c not in fields],
        *[
            F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else F.col(c)
            for c in fields
        ],
    )


DETAIL_DEFAULTS = {"full_text": "", "company_reply": "", "is_resolved": fv.UNKNOWN, "satisfaction": None}


def class_inventory(pages: DataFrame, html: str, words: list[str]) -> DataFrame:
    """(class, elements, sample): class names that contain one of the words, how many
    elements carry them, and the start of a text directly inside one."""
    found = pages.select(F.explode(H.classed_elements(html)).alias("e"))
    named = found.select(F.explode(F.array_distinct(F.split("e.classes", WS))).alias("class"), F.col("e.text").alias("text"))
    wanted = (F.col("class") != "") & F.col("class").rlike("|".join(re.escape(w) for w in words))
    sample = F.min(F.nullif(F.substring("text", 1, 60), F.lit("")))
    return named.filter(wanted).groupBy("class").agg(F.count(F.lit(1)).alias("elements"), sample.alias("sample"))
