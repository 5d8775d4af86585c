"""HTML pages as columns: one lexer pass per page, then everything is an array lookup.

`parsed(html)` gives struct(elements, texts). `elements` holds every element in page order with
its tag, attributes, classes, place, the number of elements in it (they follow it) and the range
of its texts; start and end tags are paired on a stack, so an element may hold its own kind. `texts` holds the page's pieces of text, references
decoded, trimmed, blank ones left out. The text of an element is a slice of `texts`; a block is a
substring of the page. Selectors are predicates on elements and compile to array filters.

Compute `parsed` into a column once and work on that column.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

PIECE = 1 << 20  # bytes of pages that are lexed at a time; memory follows the longest page

# A comment, raw content with its tags, a tag (quoted values may hold any character), or a declaration. The
# parts of a tag begin with different characters, so nothing that was taken is tried again (`++`, `*+`).
_MARKUP = re.compile(
    r"""(<!--.*?(?:-->|\Z)"""
    r"""|<script\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<!/)>.*?(?:</script\s*>|\Z)|<style\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<!/)>.*?(?:</style\s*>|\Z)"""
    r"""|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>)""", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=>/"'][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAGS_KEPT = 50_000
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")  # as HTML has them


class _References(dict):
    """What each reference stands for; the same ones come again and again."""

    def __missing__(self, ref: str) -> str:
        if len(self) > _TAGS_KEPT:
            self.clear()
        found = self[ref] = references.unescape(f"&{ref}")
        return found


_REFERENCES = _References()


def unescape(text: str) -> str:
    """`html.unescape`, each reference decoded once a worker."""
    if "&" not in text:
        return text
    parts = _REFERENCE.split(text)
    parts[1::2] = [_REFERENCES[ref] for ref in parts[1::2]]
    return "".join(parts)

# Fixed values of HTML: elements without content, with raw content, and those that a sibling's start tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(["script", "style"])
SIBLINGS = frozenset("p li dt dd option tr td th".split())

SCHEMA = ("struct<elements:array<struct<tag:string, attributes:map<string,string>, classes:array<string>, at:int, inside:int, parent:int, "
          "start:int, stop:int, inner_start:int, inner_stop:int, first:int, texts:int>>, texts:array<string>>")

_ELEMENT = pa.struct([
    ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())),
    ("at", pa.int32()), ("inside", pa.int32()), ("parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("inner_start", pa.int32()), ("inner_stop", pa.int32()), ("first", pa.int32()), ("texts", pa.int32())])
_PAGE = pa.struct([("elements", pa.list_(_ELEMENT)), ("texts", pa.list_(pa.string()))])


def attributes_of(raw: str) -> dict[str, str]:
    """Names in lower case with decoded values, the first of equal names; a bare name is empty."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value))
    return found


@dataclass(frozen=True)
class Tag:
    """What one piece of markup says, wherever it stands."""

    name: str               # empty for what is no tag
    ends: bool              # an end tag
    closed: bool            # has no content of its own
    attributes: dict[str, str]
    size: int               # of the start tag; raw content may follow it

    @staticmethod
    def read(markup: str) -> Tag:
        match = _TAG.match(markup)
        if not match:
            return Tag("", False, True, {}, len(markup))
        end, name, rest = match.groups()
        name = name.lower()
        known = attributes_of(rest) if rest and not end else {}
        return Tag(name, bool(end), name in VOID or name in RAW or rest.endswith("/"), known, match.end())


_TAGS: dict[str, Tag] = {}  # markup repeats from page to page


def lex(page: str) -> tuple[list[Tag], list[list[int]], list[str]]:
    """(tags of all elements, their places as in SCHEMA from `at` on, texts) of one page.

    An end tag without its start tag is ignored; one that skips open elements ends them, too.
    A start tag of SIBLINGS ends an element of its kind that it would otherwise be put directly
    into, whatever inline elements are left open in that. What is open at the end ends there.
    """
    tags: list[Tag] = []
    places: list[list[int]] = []
    texts: list[str] = []
    stack: list[list[int]] = []  # places of the open elements
    names: list[str] = []
    count = said_before = 0  # elements, texts

    def end(upto: int, inner_stop: int, stop: int) -> None:
        """Close elements down to place `upto` of the stack."""
        while len(stack) > upto:
            e = stack.pop()
            names.pop()
            e[1] = count - 1 - e[0]
            e[4] = stop if len(stack) == upto else inner_stop
            e[6], e[8] = inner_stop, said_before - e[7]

    if len(_TAGS) > _TAGS_KEPT:
        _TAGS.clear()
    parts, after = _MARKUP.split(page), 0
    last = parts.pop()
    rest = iter(parts)
    for said, markup in zip(rest, rest):
        start = after
        if said:
            start += len(said)
            if "&" in said:
                said = unescape(said)
            said = said.strip()
            if said:
                texts.append(said)
                said_before += 1
        after = start + len(markup)
        tag = _TAGS.get(markup)
        if tag is None:
            tag = Tag.read(markup)
            if len(markup) < 500:
                _TAGS[markup] = tag
        name = tag.name
        if tag.ends:
            if names and names[-1] == name:  # as in most pages
                names.pop()
                e = stack.pop()
                e[1], e[4], e[6], e[8] = count - 1 - e[0], after, start, said_before - e[7]
            elif name in names:
                upto = len(names) - 1
                while names[upto] != name:
                    upto -= 1
                end(upto, start, after)
        elif name:
            if name in SIBLINGS:
                upto = len(names) - 1
                while upto >= 0 and names[upto] != name and names[upto] in INLINE:
                    upto -= 1
                if upto >= 0 and names[upto] == name:
                    end(upto, start, start)
            tags.append(tag)
            inside = start + tag.size
            place = [count, 0, stack[-1][0] if stack else -1, start, after, inside, inside, said_before, 0]
            places.append(place)
            count += 1
            if not tag.closed:
                stack.append(place)
                names.append(name)
            elif name in RAW:
                place[6] = start + markup.rfind("</") if tag.size < len(markup) and markup.endswith(">") else after
    said = unescape(last).strip()
    if said:
        texts.append(said)
        said_before += 1
    end(0, len(page), len(page))
    return tags, places, texts


INLINE = frozenset("a abbr b big cite code em font i small span strike strong sub sup u".split())


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _pages(pages: list[str | None]) -> pa.Array:
    found = [lex(p) if p is not None else ([], [], []) for p in pages]
    every_tag = [t for tags, _, _ in found for t in tags]
    distinct = list({id(t): t for t in every_tag}.values())
    number = {id(t): k for k, t in enumerate(distinct)}
    which = [number[id(t)] for t in every_tag]
    classes = [t.attributes.get("class", "").split() for t in distinct]
    sizes = pa.array(np.concatenate(([0], np.cumsum([len(t.attributes) for t in distinct]))), pa.int32())
    what = [
        pa.array([t.name for t in distinct], pa.string()),
        pa.MapArray.from_arrays(sizes, pa.array([k for t in distinct for k in t.attributes], pa.string()),
                                pa.array([v for t in distinct for v in t.attributes.values()], pa.string())),
        _lists([len(c) for c in classes], pa.array([c for some in classes for c in some], pa.string()))]
    which = pa.array(which, pa.int32())
    rows = chain.from_iterable(places for _, places, _ in found)
    numbers = np.fromiter(chain.from_iterable(rows), np.int32).reshape(-1, len(_ELEMENT) - len(what))
    every = pa.StructArray.from_arrays([*(w.take(which) for w in what), *(pa.array(numbers[:, k]) for k in range(numbers.shape[1]))], fields=list(_ELEMENT))
    texts = [t for _, _, some in found for t in some]
    return pa.StructArray.from_arrays(
        [_lists([len(t) for t, _, _ in found], every), _lists([len(t) for _, _, t in found], pa.array(texts, pa.string()))],
        fields=list(_PAGE), mask=pa.array([p is None for p in pages], pa.bool_()))


def parsed(html: Column | str) -> Column:
    """The page as struct(elements, texts); null is null. Put it in a column before use."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            some, size = [], 0
            for page in batch.to_pylist():
                some.append(page)
                size += len(page or "")
                if size > PIECE:
                    yield _pages(some)
                    some, size = [], 0
            if some:
                yield _pages(some)

    return F.arrow_udf(run, SCHEMA).asNondeterministic()(F.col(html) if isinstance(html, str) else html)


@dataclass(frozen=True)
class Selector:
    """Which elements are meant. All that is given must hold; nothing given is every element.

    tag: one name or several. cls: a whole class name. part: each of these occurs in a class
    attribute. attribute: (name, value), or (name, None) for any value. within: text equal to
    one of these. saying: text that holds one of these, in any case.
    """

    tag: str | tuple[str, ...] = ()
    cls: str | None = None
    part: str | tuple[str, ...] = ()
    attribute: tuple[str, str | None] | None = None
    within: tuple[str, ...] = field(default=())
    saying: tuple[str, ...] = field(default=())

    def holds(self, page: Column, element: Column) -> Column:
        """The predicate on one element of a page."""
        tags, parts = (v if isinstance(v, tuple) else (v,) for v in (self.tag, self.part))
        tests = []
        if tags:
            tests.append(element["tag"].isin(*[t.lower() for t in tags]))
        if self.cls is not None:
            tests.append(F.array_contains(element["classes"], self.cls))
        if parts:
            classes = F.array_join(element["classes"], " ")
            tests += [F.contains(classes, F.lit(p)) for p in parts]
        if self.attribute is not None:
            name, value = self.attribute
            own = F.try_element_at(element["attributes"], F.lit(name.lower()))
            tests.append(own.isNotNull() if value is None else F.coalesce(own == value, F.lit(False)))
        if self.within:
            tests.append(text_of(page, element).isin(*self.within))
        if self.saying:
            said = F.lower(text_of(page, element))
            tests.append(reduce(lambda a, b: a | b, [F.contains(said, F.lit(s.lower())) for s in self.saying]))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def every(page: Column, selector: Selector, inside: Column | None = None) -> Column:
    """The matching elements in page order; with `inside`, those within that element."""

    some = page["elements"] if inside is None else F.slice(page["elements"], inside["at"] + 2, inside["inside"])
    return F.filter(some, lambda e: selector.holds(page, e))


def first(page: Column, selector: Selector, inside: Column | None = None) -> Column:
    """The first matching element; null when there is none."""
    return F.try_element_at(every(page, selector, inside), F.lit(1))


def text_of(page: Column, element: Column, sep: str = "") -> Column:
    """Everything said inside an element, pieces joined with `sep`; null for no element."""
    return F.array_join(F.slice(page["texts"], element["first"] + 1, element["texts"]), sep)


def text_without(page: Column, element: Column, left_out: Column, sep: str = "") -> Column:
    """The same without what is said inside the elements of the array `left_out`."""
    said = F.slice(page["texts"], element["first"] + 1, element["texts"])

    def stays(_: Column, k: Column) -> Column:
        at = k + element["first"]
        return ~F.exists(left_out, lambda e: (at >= e["first"]) & (at < e["first"] + e["texts"]))

    return F.array_join(F.filter(said, stays), sep)


def outer(html: Column | str, element: Column) -> Column:
    """The element as it stands in the page, tags included."""
    return F.substring(F.col(html) if isinstance(html, str) else html, element["start"] + 1, element["stop"] - element["start"])


def inner(html: Column | str, element: Column) -> Column:
    """The element's content as it stands in the page."""
    return F.substring(F.col(html) if isinstance(html, str) else html, element["inner_start"] + 1, element["inner_stop"] - element["inner_start"])


def attribute(element: Column, name: str) -> Column:
    """An attribute's decoded value; null where the element or the attribute is missing."""
    return F.try_element_at(element["attributes"], F.lit(name.lower()))


def tag_list(page: Column, selector: Selector, inside: Column | None = None) -> Column:
    """Texts of all matching elements without leading '#', joined with ', '."""
    named = F.transform(every(page, selector, inside), lambda e: F.regexp_replace(F.regexp_replace(text_of(page, e), "^#+", ""), r"^\s+", ""))
    return F.array_join(named, ", ")


def first_of(page: Column, selectors: list[tuple[str, Selector]], sep: str = "") -> tuple[Column, Column]:
    """(name, text) of the first selector in order that finds an element; null when none does."""
    hits = []
    for name, selector in selectors:
        found = first(page, selector)
        hits.append(F.when(found.isNotNull(), F.struct(F.lit(name).alias("name"), text_of(page, found, sep).alias("text"))))
    won = F.coalesce(*hits)
    return won["name"], won["text"]
