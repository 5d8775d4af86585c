"""Quality rules from repeats inside a text: suffix array, common-prefix intervals, covered share.

The words of a text form a sequence. Its suffixes are put in order by prefix doubling (only
suffixes still tied are sorted again), the longest common prefix of neighbours comes from the
kept ranks of the doubling rounds. A suffix inside an interval of common prefix >= n starts a
substring that occurs twice or more; the longest one at each position is taken, so the union
of their spans is the union of all maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.llm.textarrays import SPACED, Words, covered, flat, lists, mix, per_text, text_udf, with_result

WINDOW = 3             # words of a window of the base rule
REPEAT_WORDS = 8       # shortest repeat that counts for the covered share
COVERED_PERCENT = 30   # largest share of words inside such repeats
LONGEST_REPEAT = 100   # largest number of words of one repeat
LEAST_WORDS = 50
WINDOW_PERCENT = 50

SYMBOL = np.zeros(256, np.bool_)
SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = """struct<n_words:bigint, word_chars:bigint, n_symbols:bigint, n_dup_lines:bigint, n_repeat_words:bigint,
            covered_words:bigint, longest_repeat:bigint, spans:array<struct<start:int,stop:int>>>"""


def repeat_lengths(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the words of its longest prefix that starts elsewhere in its text too.

    `words` must differ between texts, `end` is the end of the position's text.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(words)
    place = np.arange(n)
    ranked = words[order]
    new = np.empty(n, np.bool_)
    new[0] = True
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    rounds = [rank.astype(np.int32)]

    def tied(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        alone = new.copy()
        alone[:-1] &= new[1:]
        return places[~alone]

    active, length = tied(place, new), 1
    while len(active):
        suffix = order[active]
        following = suffix + length
        inside = following < end[suffix]
        second = np.where(inside, rank[np.minimum(following, n - 1)] + 1, 0)
        key = (rank[suffix] << 32) | second
        by = np.argsort(key)
        order[active] = suffix[by]
        key = key[by]
        new = np.empty(len(key), np.bool_)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[order[active]] = active[head]
        rounds.append(rank.astype(np.int32))
        active, length = tied(active, new), length * 2

    near = np.flatnonzero(rounds[0][order[:-1]] == rounds[0][order[1:]])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(near), np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        ia, ib = a + common, b + common
        same = (ia < end[a]) & (ib < end[b])
        same &= rounds[level][np.minimum(ia, n - 1)] == rounds[level][np.minimum(ib, n - 1)]
        common += same.astype(np.int64) << level
    best = np.zeros(n, np.int64)
    best[b] = common  # a suffix follows at most one neighbour
    best[a] = np.maximum(best[a], common)
    return best


def measure(texts: pa.Array, repeat_words: int = REPEAT_WORDS) -> pa.Array:
    data, offsets = flat(texts)
    words = Words(data, offsets, SPACED)
    n = len(words)
    end = words.first[1:][words.text]
    own = mix(words.values() ^ mix((words.text + 1).astype(np.uint64)))
    reach = repeat_lengths(own, end)
    place = np.arange(n)

    def inside(least: int) -> np.ndarray:
        at = place[reach >= least]
        return covered(at, at + reach[at], n)

    in_repeat = inside(repeat_words)
    edge = np.zeros(n, np.bool_)
    edge[words.first[:-1][words.per_text > 0]] = True
    opens = in_repeat & (edge | ~np.concatenate(([False], in_repeat[:-1])))
    last = np.concatenate((edge[1:], [True])) if n else edge
    closes = in_repeat & (last | ~np.concatenate((in_repeat[1:], [False])))
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    base = words.first[:-1][words.text[starts]]
    spans = pa.StructArray.from_arrays(
        [pa.array((starts - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], ["start", "stop"])

    longest = np.zeros(len(texts), np.int64)
    some = words.per_text > 0
    if n:
        longest[some] = np.maximum.reduceat(reach, words.first[:-1][some])
    lead = (data & 0xC0) != 0x80
    lines = np.fromiter((repeated_lines(t) for t in texts.to_pylist()), np.int64, len(texts))
    return pa.StructArray.from_arrays([
        pa.array(words.per_text.astype(np.int64)),
        pa.array(per_text(words.keep & lead, offsets)),
        pa.array(per_text(SYMBOL[data], offsets)),
        pa.array(lines),
        pa.array(per_text(inside(WINDOW), words.first)),
        pa.array(per_text(in_repeat, words.first)),
        pa.array(longest),
        lists(per_text(opens, words.first), spans),
    ], ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "spans"])


def repeated_lines(text: str | None) -> int:
    """Lines that hold a word and equal an earlier line."""
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return repeats


def with_repetition(
    docs: DataFrame, text: str = "text", out: str = "repetition", repeat_words: int = REPEAT_WORDS,
    covered_percent: int = COVERED_PERCENT, longest_repeat: int = LONGEST_REPEAT,
) -> DataFrame:
    """`docs` plus a struct of counts, merged repeat spans (word positions), `base_failed` and `kept`.

    Rejected by the method: more than `covered_percent` of the words lie in repeats of
    `repeat_words` words or more, or one repeat is longer than `longest_repeat` words.
    Null and empty texts have no words, fail the base rule and are not kept. Every row is
    judged for itself: repeated rows get equal results, an empty table gives an empty one,
    an input column called as `out` is replaced.
    """
    def work(texts: pa.Array) -> pa.Array:
        return measure(texts, repeat_words)

    found = with_result(docs, out, text_udf(work, SCHEMA)(F.col(text)))
    m = lambda name: F.col(f"{out}.{name}")
    base_failed = (m("n_words") < LEAST_WORDS) | (m("n_repeat_words") * 100 > m("n_words") * WINDOW_PERCENT)
    repeated = (m("covered_words") * 100 > m("n_words") * covered_percent) | (m("longest_repeat") > longest_repeat)
    return found.withColumn(out, F.col(out).withField("base_failed", base_failed)
                            .withField("kept", ~(base_failed | repeated)))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """Rows of `docs` that pass the rules, with their columns as they were."""
    mark = "__repetition"
    return with_repetition(docs, out=mark, **settings).filter(F.col(mark)["kept"]).select(*docs.columns)
