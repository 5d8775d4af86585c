import re

from hypothesis import given, settings, strategies as st

from plaintscope.llm import decontamination as dc

WORDS = st.lists(st.sampled_from(["a", "b", "c"]), max_size=60).map(" ".join)


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    w, hit, names = split(text), set(), set()
    for name, passage in items:
        p = split(passage)
        k = min(13, len(p))
        for at in range(len(p) - k + 1) if p else ():
            for i in range(len(w) - k + 1):
                if w[i:i + k] == p[at:at + k]:
                    hit.update(range(i, i + k))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=3), st.lists(WORDS, max_size=4))
def test_search_against_brute_force(texts, passages):
    items = [(str(k), p) for k, p in enumerate(passages)]
    found = dc.searchers(items)
    for text in texts:
        hits = [h for s in found for h in s.search(dc.words_of(text.encode()))]
        n, n_hit, names, _ = brute(text, items)
        assert len({p for a, b, _ in hits for p in range(a, b)}) == n_hit
        assert sorted(set().union(*(h[2] for h in hits))) == names


def rows_and_items():
    passage = " ".join(f"Word{k}" for k in range(20))
    filler = " ".join(f"x{k}" for k in range(400))
    items = [(1, passage), (2, "short one."), (3, None), (4, ""), (None, "nameless passage here"), (5, passage), (10, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 é")]
    rows = [(1, passage.upper()), (2, filler + " " + passage), (3, filler * 3 + " " + passage), (4, "SHORT, one"), (5, None), (6, ""), (7, "clean text"),
            (8, "a nameless passage here"), (8, "a nameless passage here"), (None, passage), (9, "x1-x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 É é")]
    return rows, items


def check(spark, **settings):
    rows, items = rows_and_items()
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"]), r.contamination.contaminated)
           for r in dc.with_contamination(docs, bench, **settings).collect()]
    assert sorted(got, key=str) == sorted([(k, *brute(t, items)) for k, t in rows], key=str)
    kept = dc.drop_contaminated(docs, bench, **settings)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute(t, items)[3] for _, t in rows)
    assert dc.with_contamination(docs.limit(0), bench).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_frame_cases(spark):
    check(spark)


def test_a_benchmark_in_blocks(spark):
    check(spark, block_bytes=120)
