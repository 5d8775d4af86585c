"""Token arrays changed in place, in the tasks, or by a join: always the same rows."""

import random

import pytest

from plaintscope.operators import features as X, tokens as K
from plaintscope.session import stage

RNG = random.Random(5)
WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k % 7 or None, f"text {k}", [RNG.choice([*WORDS, None]) for _ in range(RNG.randrange(12))]) for k in range(60)]
    rows += [(1, "none", None), (1, "empty", []), (2, "twin", ["w1", "w1"]), (2, "twin", ["w1", "w1"])]
    return rows, spark.createDataFrame(rows, "id int, text string, words array<string>").repartition(4)


def told(df):
    return sorted((str(r.id), r.text, str(r.words)) for r in df.collect())


@pytest.mark.parametrize("settings", [{"max_listed": 0}, {"max_listed": 0, "max_rows": 12}, {"max_listed": 0, "max_rows": 3}, {}])
def test_stop_words(spark, docs, settings):
    rows, df = docs
    stops = [*WORDS[:10], *[f"unseen{k}" for k in range(30)], None, "w1"]
    table = spark.createDataFrame([(s,) for s in stops], "term string")
    want = sorted((str(i), t, str(None if w is None else [x for x in w if x is None or x not in stops])) for i, t, w in rows)
    assert told(K.drop_tokens(df, "words", table, **settings)) == want


@pytest.mark.parametrize("settings", [{}, {"max_rows": 15}, {"max_rows": 3}])
def test_stems(spark, docs, settings):
    rows, df = docs
    pairs = [(w, w[0]) for w in WORDS[:12]] + [("w3", "a"), ("w5", None), (None, "z")] + [(f"unseen{k}", "u") for k in range(30)]
    table = spark.createDataFrame(pairs, "token string, stem string")
    stem = {w: w[0] for w in WORDS[:12]} | {"w3": "a"}
    want = sorted((str(i), t, str(None if w is None else [stem.get(x, x) for x in w])) for i, t, w in rows)
    assert told(K.apply_stems(df, "words", table, **settings)) == want


def test_texts_do_not_move(spark, docs):
    table = spark.createDataFrame([("w1", "x")], "token string, stem string")
    plan = K.apply_stems(docs[1], "words", table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # that of the test's own repartition


def test_large_vocabularies_give_the_same_counts_and_weights(spark):
    rows = [(f"g{k % 30}" if k % 30 else None, k, [RNG.choice(WORDS) for _ in range(25)]) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, words array<string>").repartition(5)
    vocab = stage(X.vocabulary(df, "g", "words", min_df=2, max_share=1.0))
    weights = stage(X.tfidf_vocabulary(df, "g", "words"))
    plain = lambda d: sorted((str(r.g), r.id, r.term, round(float(r[3]), 9)) for r in d.collect())
    small, large = (X.bag_of_words(df, "g", "id", "words", vocab, max_rows=n) for n in (100_000, 200))
    assert vocab.count() > 400 and plain(small) == plain(large)
    assert plain(X.tfidf(df, "g", "id", "words", weights)) == plain(X.tfidf(df, "g", "id", "words", weights, max_rows=200))
    want = {(str(g), i, w): ws.count(w) for g, i, ws in rows for w in ws}
    known = {(str(r.g), r.term) for r in vocab.collect()}
    assert {(g, i, w): int(n) for g, i, w, n in plain(small)} == {k: n for k, n in want.items() if (k[0], k[2]) in known}
