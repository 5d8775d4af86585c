"""Lexical search beside brute force over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaintscope.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    """{(item place): [(score, key)]} by the definition."""
    held = [(k, Counter(terms(t))) for k, t in docs]
    size = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in held for t in c)
    found = []
    for _, text in items:
        scores = []
        for (key, c), mine in zip(held, size):
            if not mine:
                continue
            m = 25 + 75 * mine * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((score, key))
        found.append(sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1]))[:best])
    return found


def run(spark, docs, items, parts=3, **settings):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "terms": F.lit(1), "rank": F.lit(2)})
    path = ls.new_folder(spark)
    ls.write_index(table.repartition(parts), path)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumns({"score": F.lit("x"), "key": F.lit(2)})
    rows = ls.search(spark.read.parquet(path), asked, **settings).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (str(r.item_id), r["rank"])):
        found.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r["rank"] == len(found[r.item_id])
    return found


def random_texts(rng, count, vocabulary=60, longest=80):
    words = [f"w{k}" if k % 3 else f"Wörter{k}" for k in range(vocabulary)]
    return [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(vocabulary)], k=rng.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = random_texts(rng, 400)
    docs = [(k, t) for k, t in enumerate(texts + texts[:100] + ["", "-- !", "w1 " * 700, " ".join(f"x{k}" for k in range(9000)) + " w5"])]
    docs += [(9000, None), (None, "w1 w2 w3"), (7, texts[3])]
    items = [(f"i{k}", t) for k, t in enumerate(random_texts(rng, 40))] + [("none", "absent words"), ("empty", ""), ("null", None), ("twice", "w4 w4 W4 x7")]
    found = run(spark, docs, items)
    for (name, _), want in zip(items, brute(docs, items)):
        assert found.get(name, []) == want


def test_blocks_and_more_of_the_best(spark):
    rng = random.Random(9)
    docs, items = list(enumerate(random_texts(rng, 200))), [(f"i{k}", t) for k, t in enumerate(random_texts(rng, 30))]
    want = brute(docs, items, 25)
    assert [run(spark, docs, items, best=25, block_items=7).get(name, []) for name, _ in items] == want


def test_ties_keep_the_least_keys_and_repeated_items_their_rows(spark):
    docs = [(k, "same text here") for k in range(500)] + [(900 + k, "other") for k in range(600)] + [(None, "same text here")]
    found = run(spark, docs, [("a", "text"), ("b", "text same")], parts=7)
    assert [k for _, k in found["a"]] == list(range(10)) == [k for _, k in found["b"]]
    table = spark.createDataFrame(docs[:5], "doc_id long, text string")
    path = ls.new_folder(spark)
    ls.write_index(table, path)
    items = spark.createDataFrame([("a", "text"), ("a", "text"), (None, "text")], "item_id string, text string")
    rows = ls.search(spark.read.parquet(path), items).collect()
    assert sorted((str(r.item_id), r["rank"], r.doc_id) for r in rows) == sorted((n, k + 1, k) for n in ("a", "a", "None") for k in range(5))


def test_empty_tables(spark):
    assert run(spark, [], [("a", "text")]) == {} == run(spark, [(1, "text")], []) == run(spark, [(1, None)], [("a", None)])


def test_bounds_hold_and_spare_work():
    rng = random.Random(2)
    texts = random_texts(rng, 3000, vocabulary=4000) + ["w3 " * 300]
    n, owner, hashes, counts = ls.terms_of(pa.array(texts))
    found, offsets = ls.sketches(owner, hashes, counts, len(texts))
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(n.astype(np.int64)), ls.binaries(offsets, found), ls.binaries(ends, hashes), ls.binaries(ends, counts.astype(np.uint32))],
        ["key", "n", "sketch", "terms", "counts"])
    block = ls.block_of(random_texts(rng, 20, vocabulary=4000) + ["w3"])
    block.documents, block.total = int((n > 0).sum()), int(n.sum())
    block.weigh(np.array([(hashes == t).sum() for t in block.terms]))
    docs = ls.Documents(batch, block)
    weights = np.zeros((len(block.terms), len(block.columns)), np.float32)
    for item, columns in enumerate(block.columns):
        weights[columns, item] = block.weight[columns] * block.times[item]
    exact = docs.exact(np.arange(len(texts))).astype(np.int64) @ weights.astype(np.int64)
    widths = np.diff(docs.sketch_at) // ls.ROWS
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        assert (docs.bounds(rows, int(width), weights) >= exact[rows]).all()
    best = ls.Best(len(block.columns), 10)
    scored = docs.search(best, weights)
    assert 0 < scored < 0.2 * (exact > 0).sum() + 10 * 16 * len(block.columns)
    for item in range(len(block.columns)):
        want = sorted(((-s, k) for k, s in enumerate(exact[:, item].tolist()) if s > 0))[:10]
        assert [(-s, k) for s, k in zip(best.scores[item].tolist(), best.keys[item].tolist())] == want
