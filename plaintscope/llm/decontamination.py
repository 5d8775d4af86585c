"""Benchmark passages in documents: Wu-Manber search over words.

A test string is 13 consecutive words of a benchmark item (an item with fewer words is one
test string). The text is a sequence of words; two words form a block. The shift table gives
for each block how far the window may move without missing a test string, so most positions
are never looked at; a shift of zero leads through the block's bucket to the test strings,
and comparing the words decides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaintscope.llm.textarrays import flat, lists, pieces, with_result
from plaintscope.session import stage

WINDOW = 13
# Bytes of benchmark text searched for in one pass over the documents. A larger benchmark is
# searched block by block, so what is broadcast never grows with it.
BLOCK_BYTES = 16 << 20
HIT_SHARE = 20  # contaminated if HIT_SHARE * n_hit >= n_words

# Words of ASCII-lower-cased UTF-8: 0-9, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower changes A-Z only


class WuManber:
    """Shift table and buckets for test strings of at least `least` words."""

    def __init__(self, strings: dict[tuple[bytes, ...], set[str]], least: int):
        self.least, self.block = least, min(2, least)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]] = {}
        for string, items in strings.items():
            for stop in range(self.block, least + 1):
                key = string[stop - self.block:stop]
                self.shift[key] = min(self.shift.get(key, least), least - stop)
            self.bucket.setdefault(string[least - self.block:least], []).append((list(string), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, stop, items) of each occurrence."""
        least, block, shift, bucket = self.least, self.block, self.shift, self.bucket
        furthest, stop, n = least - block + 1, least, len(words)
        while stop <= n:
            key = tuple(words[stop - block:stop])
            move = shift.get(key, furthest)
            if move:
                stop += move
                continue
            start = stop - least
            for string, items in bucket[key]:
                if words[start:start + len(string)] == string:
                    yield start, start + len(string), items
            stop += 1


def searchers(items: list[tuple[str | None, str]]) -> list[WuManber]:
    """One searcher for the windows of full length and one for the shorter items."""
    strings: dict[bool, dict[tuple[bytes, ...], set[str]]] = {True: {}, False: {}}
    for item, text in items:
        words = words_of(text.encode())
        for at in range(max(1, len(words) - WINDOW + 1)) if words else ():
            string = tuple(words[at:at + WINDOW])
            names = strings[len(string) == WINDOW].setdefault(string, set())
            if item is not None:
                names.add(item)
    return [WuManber(s, min(map(len, s))) for s in strings.values() if s]


def scan(data: bytes, offsets: np.ndarray, found: list[WuManber]) -> pa.Array:
    """n_words, merged spans of hit words and item ids of each text."""
    counts, spans, items, n_spans, n_items = [], [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        words = words_of(data[a:b])
        hits = sorted((h for s in found for h in s.search(words)), key=lambda h: h[:2])
        merged: list[list[int]] = []
        for start, stop, _ in hits:
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        names = sorted(set().union(*(h[2] for h in hits))) if hits else []
        counts.append(len(words))
        spans += merged
        items += names
        n_spans.append(len(merged))
        n_items.append(len(names))
    pairs = pa.StructArray.from_arrays(
        [pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())], ["start", "stop"])
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), lists(np.array(n_spans, np.int64), pairs),
         lists(np.array(n_items, np.int64), pa.array(items, pa.string()))], ["n_words", "spans", "items"])


_READY: dict[str, list[WuManber]] = {}


def _searchers(shared) -> list[WuManber]:
    """Tables of a broadcast block, built once a worker."""
    if shared.value[0] not in _READY:
        _READY.clear()
        _READY[shared.value[0]] = searchers(shared.value[1])
    return _READY[shared.value[0]]


def _pass(shared):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _searchers(shared)
        for texts in batches:
            for start, stop in pieces(texts):
                data, offsets = flat(texts.slice(start, stop - start))
                yield scan(data.tobytes(), offsets, tables)

    return F.arrow_udf(run, "struct<n_words:bigint, spans:array<struct<start:int,stop:int>>, items:array<string>>").asNondeterministic()


def with_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "contamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` plus a struct: n_words, spans of hit words (start, stop; merged), n_hit, items, contaminated.

    The benchmark is read in blocks of about `block_bytes` of text, each broadcast for one
    pass; with more than one the rows are staged between passes. Null texts have no words.
    Items of equal id count once; the words of items without id hit but name no item. An
    empty benchmark hits nothing, empty `docs` stay empty, repeated rows get equal results,
    an input column called as `out` is replaced.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("passage")).filter("passage IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = docs
    for k in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == k) if blocks > 1 else named
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, r.passage) for r in part.collect()]))
        found = with_result(found, f"__pass_{k}", _pass(shared)(F.col(text)))
        if blocks > 1:
            found = stage(found)
            shared.unpersist()
    passes = [F.col(f"__pass_{k}") for k in range(blocks)]
    spans = F.array_sort(F.flatten(F.array(*[p["spans"] for p in passes])))
    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), _merge)
    result = F.struct(
        passes[0]["n_words"].alias("n_words"), (passes[0]["spans"] if blocks == 1 else merged).alias("spans"),
        (passes[0]["items"] if blocks == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in passes]))))).alias("items"),
    )
    found = with_result(found, out, result).drop(*[f"__pass_{k}" for k in range(blocks)])
    n_hit = F.aggregate(F.col(out)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]))
    found = found.withColumn(out, F.col(out).withField("n_hit", n_hit))
    hit, n = F.col(out)["n_hit"], F.col(out)["n_words"]
    return found.withColumn(out, F.col(out).withField("contaminated", (hit > 0) & (hit * HIT_SHARE >= n)))


def _merge(kept, span):
    """One more span, in order of start, into disjoint spans."""
    last = F.element_at(kept, -1)
    joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
    overlaps = (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1))["stop"] >= span["start"])
    return F.when(overlaps, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(joined))).otherwise(F.concat(kept, F.array(span)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Rows of `docs` that are not contaminated, with their columns as they were."""
    mark = "__contamination"
    return with_contamination(docs, benchmark, out=mark, **settings).filter(~F.col(mark)["contaminated"]).select(*docs.columns)
