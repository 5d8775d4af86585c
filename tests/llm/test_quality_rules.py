import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from plaintscope.llm import quality_rules

TEXT = st.lists(st.sampled_from(["a", "b", "é", "#x", " ", "\n", "  ", "\t"]), max_size=80).map("".join)


def brute(text, least):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return {p for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for p in range(i, i + k)}

    longest = max((k for k in range(1, len(w) + 1) if inside(k)), default=0)
    hit = sorted(inside(least))
    spans = []
    for p in hit:
        if spans and spans[-1][1] == p:
            spans[-1][1] = p + 1
        else:
            spans.append([p, p + 1])
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": sum(lines.values()) - len(lines), "n_repeat_words": len(inside(3)), "covered_words": len(hit),
            "longest_repeat": longest, "spans": [{"start": a, "stop": b} for a, b in spans]}


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 9))
def test_measures_against_brute_force(texts, least):
    got = quality_rules.measure(pa.array(texts, pa.string()), least).to_pylist()
    assert got == [brute(t, least) for t in texts]


def test_long_periodic_text():
    got = quality_rules.measure(pa.array(["of " * 50_000, "x " * 3 + "y"])).to_pylist()
    assert got[0]["longest_repeat"] == 49_999 and got[0]["covered_words"] == 50_000
    assert got[1]["longest_repeat"] == 2


def test_frame_cases(spark):
    clean = " ".join(f"w{k}" for k in range(120))
    rows = [(1, None), (2, ""), (3, clean), (3, clean), (None, clean), (5, "a b c " * 40), (6, clean + " " + clean), (7, "few words")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, Repetition string")
    got = quality_rules.with_repetition(docs)
    assert got.columns == ["doc_id", "text", "repetition"]
    kept = [(r.doc_id, r.repetition.base_failed, r.repetition.kept) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, True, False), (2, True, False), (3, False, True), (3, False, True), (None, False, True),
                                            (5, True, False), (6, True, False), (7, True, False)], key=str)
    assert quality_rules.keep_good(docs).count() == 3
    assert quality_rules.with_repetition(docs.limit(0)).count() == 0


def test_verdict_of_the_method(spark):
    unique = " ".join(f"u{k}" for k in range(400))
    long_one = " ".join(f"p{k}" for k in range(110))
    short_ones = " ".join(f"q{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{unique} {long_one} z {long_one} y"), (2, f"{unique} {short_ones} z {short_ones} y")], "doc_id long, text string")
    got = {r.doc_id: r.repetition for r in quality_rules.with_repetition(docs).collect()}
    assert not got[1].base_failed and not got[1].kept and got[1].longest_repeat == 110
    assert got[2].kept and got[2].covered_words == 120
