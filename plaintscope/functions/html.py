"""HTML extraction as Column expressions over well-formed tag text.

Elements are matched from their opening tag to the next closing tag of the same name,
so a pattern should name an element that does not contain its own kind.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from plaintscope.functions import fixed_values as fv
from plaintscope.functions.text import evaluate_once, strip

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
_TAG = r"<[^>]*>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def opening(tag: str, cls: str | tuple[str, ...] | None = None, exact: bool = True) -> str:
    """Pattern of an opening tag. `exact` asks for the whole class name, otherwise `cls`
    may be any part of the class attribute; of several parts all must occur."""
    if cls is None:
        return rf"<{tag}\b[^>]*>"
    if isinstance(cls, tuple):
        parts = "".join(rf"(?=[^\"]*{re.escape(c)})" for c in cls)
        return rf"<{tag}\b[^>]*\bclass=\"{parts}[^\"]*\"[^>]*>"
    name = re.escape(cls).replace(r"\-", "-")
    inner = rf"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?" if exact else rf"[^\"]*{name}[^\"]*"
    return rf"<{tag}\b[^>]*\bclass=\"{inner}\"[^>]*>"


def element(tag: str, cls: str | None = None, exact: bool = True) -> str:
    """Pattern of a whole element; group 1 is its inner HTML."""
    return rf"(?s){opening(tag, cls, exact)}(.*?)</{tag}>"


def visible(html: Column | str) -> Column:
    """Without comments, scripts and style sheets."""
    return F.regexp_replace(_c(html), _HIDDEN, "")


def decode_entities(c: Column | str) -> Column:
    """Character references decoded, all in one pass: named (those of HTML 4 and `&apos;`, with
    their semicolon), decimal and hexadecimal (with or without). What one decodes to is not
    decoded again; an unknown name stays as it is."""
    c = _c(c)
    pieces = F.split(c, "&")
    later = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    refs = F.transform(later, lambda p: F.regexp_extract(p, _REFERENCE, 1))

    def decoded(refs: Column) -> Column:
        few = F.array_distinct(F.slice(refs, 1, F.least(F.size(refs), F.lit(REFERENCES_READ))))
        known = F.map_from_arrays(F.slice(few, 1, REFERENCES_KEPT), F.transform(F.slice(few, 1, REFERENCES_KEPT), _meaning))
        return evaluate_once(known, lambda known: F.zip_with(later, refs, lambda piece, ref: _decoded(piece, ref, known)))

    return F.when(F.contains(c, F.lit("&")), F.concat(pieces[0], F.array_join(evaluate_once(refs, decoded), ""))).otherwise(c)


REFERENCES_READ, REFERENCES_KEPT = 1_000, 16  # of a text's references, those whose characters are looked up


def _decoded(piece: Column, ref: Column, known: Column) -> Column:
    """What follows an ampersand, with the reference that it begins with as its character."""
    char = F.when(F.map_contains_key(known, ref), F.try_element_at(known, ref)).otherwise(_meaning(ref))
    rest = F.substr(piece, F.length(ref) + 1)
    return evaluate_once(char, lambda found: F.coalesce(F.concat(found, rest), F.concat(F.lit("&"), piece)))


def _meaning(ref: Column) -> Column:
    """The character of a reference (without its ampersand); null for none."""
    digits = F.regexp_replace(ref, "[#;]", "")
    number = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 20), 16, 10)).otherwise(digits).cast("bigint")
    return F.when(ref.startswith("#"), evaluate_once(number, _character)).otherwise(F.try_element_at(_names(), F.rtrim(ref, F.lit(";"))))


def _character(number: Column) -> Column:
    """The character of a numeric reference. 128 to 159 mean Windows-1252, as in every browser."""
    odd = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    old = F.substr(F.lit(fv.WINDOWS_1252), (number - 127).cast("int"), F.lit(1))
    exact = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(odd, "\ufffd").when(number.between(128, 159), old).when(number.isNotNull(), exact)


_REFERENCE = "^(#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;)"


def _names() -> Column:
    named = {"apos": 0x27, **name2codepoint}
    return F.create_map(*[F.lit(x) for name, code in named.items() for x in (name, chr(code))])


def html_to_text(html: Column | str, sep: str = "") -> Column:
    """Text between tags: each piece trimmed, blank ones dropped, joined with `sep`."""
    pieces = F.split(visible(html), _TAG)
    trimmed = F.transform(pieces, lambda p: strip(decode_entities(p)))
    return F.array_join(F.filter(trimmed, lambda p: p != ""), sep)


def blocks(html: Column | str, tag: str, cls: str | None = None, exact: bool = False) -> Column:
    """All elements of a kind, whole, in page order."""
    return F.regexp_extract_all(_c(html), F.lit(element(tag, cls, exact)), F.lit(0))


def first_inner(html: Column | str, tag: str, cls: str | None = None, exact: bool = True) -> Column:
    """Inner HTML of the first such element; null when there is none."""
    html, pattern = _c(html), element(tag, cls, exact)
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def extract_text(html: Column | str, tag: str, cls: str | None = None, default: str | None = "",
                 sep: str = "", exact: bool = True) -> Column:
    """Text of the first such element, or the default when there is none."""
    text = html_to_text(first_inner(html, tag, cls, exact), sep)
    return text if default is None else F.coalesce(text, F.lit(default))


def nested_text(html: Column | str, cls: str, sep: str = "", exact: bool = True,
                tag: str = "[a-zA-Z][a-zA-Z0-9]*") -> Column:
    """Text of the first element of the class, of any kind and with anything nested in it,
    its own kind too; null when there is none.

    The page is cut into tags and texts, and a fold over them finds the matching end tag.
    """
    start_tag = "^" + opening(tag, cls, exact)

    def name(piece: Column) -> Column:
        return F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))

    def inner(pieces: Column) -> Column:
        def end_of(own: Column) -> Column:
            def step(state: Column, piece: Column) -> Column:
                same = name(piece) == own
                change = F.when(same & piece.startswith("</"), -1).when(same & ~piece.endswith("/>"), 1).otherwise(0)
                depth, at = state["depth"] + change, state["at"] + 1
                end = F.when((state["end"] == 0) & (depth == 0), at).otherwise(state["end"])
                return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

            start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
            return F.aggregate(pieces, start, step, lambda state: state["end"])

        end = evaluate_once(name(pieces[0]), end_of)
        return evaluate_once(end, lambda e: F.slice(pieces, 2, F.when(e == 0, F.size(pieces)).otherwise(e - 2)))

    def text(pieces: Column) -> Column:
        at = F.array_position(F.transform(pieces, lambda p: p.rlike(start_tag)), True)
        kept = evaluate_once(F.slice(pieces, at.cast("int"), F.size(pieces)), inner)
        words = F.transform(kept, lambda p: F.when(p.startswith("<"), "").otherwise(strip(decode_entities(p))))
        return F.array_join(F.filter(words, lambda w: w != ""), sep)

    html = _c(html)
    found = html.rlike(opening(tag, cls, exact))
    pieces = F.regexp_extract_all(visible(html), F.lit("<[^>]*>|[^<]+"), F.lit(0))
    # A start tag inside a comment or script is no element.
    shown = F.exists(pieces, lambda p: p.rlike(start_tag))
    return F.when(found & shown, evaluate_once(pieces, text))


def extract_attr(html: Column | str, tag: str, attr: str, default: str = "") -> Column:
    """Attribute of the first such tag that carries it, entities decoded. Tag and name in any
    case, the value in either kind of quotes or bare; the name is a whole one (`href` is not
    found in `data-href`)."""
    up_to = rf"(?is)<{tag}\b[^>]*?\s{re.escape(attr)}\s*=\s*"
    found = F.regexp_substr(_c(html), F.lit(up_to + r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"))
    quoted = F.regexp_replace(found, up_to.replace("(?is)", "(?is)^"), "")
    value = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.when(found.isNotNull(), decode_entities(value)).otherwise(default)


def extract_tags(html: Column | str, tag: str, cls: str | None = None) -> Column:
    """Texts of all such elements without their leading '#', joined with ', '."""
    inner = F.regexp_extract_all(_c(html), F.lit(element(tag, cls, exact=False)), F.lit(1))
    named = F.transform(inner, lambda t: strip(F.regexp_replace(html_to_text(t), r"^#+", "")))
    return F.array_join(named, ", ")


def strip_elements(html: Column | str, tag: str, cls: str) -> Column:
    return F.regexp_replace(_c(html), element(tag, cls), "")


def first_match(html: Column | str, selectors: list[tuple[str, str, str | None]]) -> tuple[Column, Column]:
    """(name, text) of the first selector in order that finds an element.

    A selector is (name, tag, class or None).
    """
    html = _c(html)
    hits = [
        F.when(html.rlike(element(tag, cls)), F.struct(F.lit(name).alias("name"),
                                                      extract_text(html, tag, cls).alias("text")))
        for name, tag, cls in selectors
    ]
    won = F.coalesce(*hits)
    return won["name"], won["text"]


def classed_elements(html: Column | str) -> Column:
    """(classes, text) of every start tag with a class: the attribute and the text right after."""
    def build(page: Column) -> Column:
        pattern = r"<[a-zA-Z][^>]*\bclass=\"([^\"]*)\"[^>]*>([^<]*)"
        classes, texts = (F.regexp_extract_all(page, F.lit(pattern), F.lit(i)) for i in (1, 2))
        return F.zip_with(classes, texts, lambda c, t: F.struct(c.alias("classes"), strip(decode_entities(t)).alias("text")))

    return evaluate_once(visible(html), build)
