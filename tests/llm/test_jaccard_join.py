import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plaintscope.llm import jaccard_join as jj, queries
from plaintscope.llm.components import connected_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(key, least key of the class, least key of equal sets, links) of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for other in {o for x in s for o in where[x] if o > k}:
            both = len(s & sets[other])
            if both * 9 >= 4 * (len(s) + len(sets[other])):
                links[k] += 1
                links[other] += 1
                parent[root(other)] = root(k)
    least = lambda group: min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
    out = []
    for k, s in enumerate(sets):
        same = [o for o in range(len(rows)) if sets[o] == s] if s else [k]
        out.append((rows[k][0], least([o for o in range(len(rows)) if root(o) == root(k)]), least(same), links[k]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "copy_id", "n_links").collect()), key=str)


@pytest.fixture(scope="module")
def hard():
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randrange(3000)
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 120))) for _ in range(150)]
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rnd.randrange(20, 200))) for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(120):  # one large group of near copies, most linked to most
        copy = list(base)
        for _ in range(rnd.randrange(0, 4)):
            copy[rnd.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [texts[3]] * 50 + ["a b", "a b", "A  b", "one", "", None, "  \n", ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "all alone here"), (7, texts[7]), (7, texts[7])]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force_on_hard_rows(spark, hard, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 512)
    docs = spark.createDataFrame([(k, t, "x") for k, t in hard], "doc_id long, text string, class string").repartition(5)
    assert result(jj.near_duplicates(docs)) == brute(hard)


def test_blocks_give_the_same(spark, hard):
    docs = spark.createDataFrame(hard, "doc_id long, text string")
    plain = jj.in_blocks.__defaults__
    try:
        jj.in_blocks.__defaults__ = (40,)
        assert result(jj.near_duplicates(docs)) == brute(hard)
    finally:
        jj.in_blocks.__defaults__ = plain


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op6_jaccard_join"](spark, small)) == brute(rows)


def test_one_of_each_class_is_kept(spark, hard):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in hard], "doc_id long, text string, d1 string, row int")
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    expected = brute(hard)
    classes = {c for k, c, _, _ in expected if c is not None}
    empty = [k for k, t in hard if not shingles(t)]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(classes)
    assert sum(r.doc_id is None for r in got) == 1  # "all alone here"
    assert all(k in {r.doc_id for r in got} for k in empty)
    assert jj.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (50, 50), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 50: 50}


def test_estimates_and_chances():
    assert jj.meet_chance(0.8, 1) == pytest.approx(0.84)
    assert (1 - jj.meet_chance(0.8, jj.DEPTH)) ** jj.RUNS <= 1 - jj.RECALL
    a, b = " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(40, 440))
    tokens = jj.sampled_tokens(*jj.shingle_sets(pa.array([a, b, "", None])))
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((tokens[0] == tokens[1]).mean() - true) < 0.2
    assert not tokens[2:].any()
    assert np.array_equal(jj.intersections(*jj.shingle_sets(pa.array([a, b]))), [[396, 356], [356, 396]])
