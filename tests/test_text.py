import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaintscope.functions import text as X
from plaintscope.functions.dates import parse_tr_date, to_date_coerce
from plaintscope.functions.scalars import (
    absolute_url, band, binarise, clip_upper, direction, erfc, p_label, resolution_status, safe_double, safe_int, slug, verdict,
)
from plaintscope.operators import tokens as K

STOPS = ["ve", "için", "banka"]


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text, expected", [
    ("Hesabım BLOKE!! https://t.co/abc @banka_tr 123", ["hesabım", "bloke"]),
    ("kart_ücreti  kart ücreti", ["kart", "ücreti", "kart", "ücreti"]),
    ("50TL iade2kez", ["iade", "kez"]),
    ("a bb ccc", ["ccc"]),
    ("ve için banka", []),
    ("www.x.com/a şubeye\tgitti", ["şubeye", "gitti"]),
    ("", []),
    (None, []),
])
def test_normaliser(spark, text, expected):
    assert one(spark, text, lambda c: X.word_tokens(c, STOPS)) == expected


def test_turkish_casing(spark):
    text = "İADE ve ücret için banka IŞIK"
    assert one(spark, text, lambda c: X.word_tokens(c, STOPS)) == ["ade", "ücret", "işik"]
    assert one(spark, text, lambda c: X.word_tokens(c, STOPS, locale="tr")) == ["iade", "ücret", "ışık"]


def test_normaliser_equals_single_steps(spark):
    texts = ["A1b_c @x_y http://q/w?e Ⅷ½ iki\x0büç\x1fbeş şık​sız", "@http://x.y @www.z", "x" * 40 + "!é́ e"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    steps = X.collapse_spaces(X.underscores_to_spaces(X.remove_punctuation(
        X.remove_digits(X.remove_mentions(X.remove_urls(X.lower("v")))))))
    rows = df.select(X.word_tokens("v").alias("a"), X.min_token_len(X.tokenise(steps)).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


@pytest.mark.parametrize("text, n", [("  a  b ", 2), ("", 0), (None, 0), ("a b\x85c", 3)])
def test_word_count(spark, text, n):
    assert one(spark, text, X.word_count) == n


@pytest.mark.parametrize("text, expected", [
    ("15 Kasım 2025 09:30", dt.date(2025, 11, 15)),
    ("5 Şubat 00:14", dt.date(2026, 2, 5)),
    ("26 Şubat 00:14", dt.date(2025, 2, 26)),
    ("31 Şubat 2025", None),
    ("3 Foo 2025", None),
    ("29 Şubat", None),
    ("", None),
    (None, None),
])
def test_turkish_dates(spark, text, expected):
    assert one(spark, text, lambda c: parse_tr_date(c, F.lit("2026-02-10").cast("date"))) == expected


def test_coerced_date(spark):
    assert one(spark, "2025-02-30", to_date_coerce) is None
    assert one(spark, "2025-02-03", to_date_coerce) == dt.date(2025, 2, 3)


def test_ngrams(spark):
    assert one(spark, ["a", "b", "c"], lambda c: X.ngrams(c, 1, 2), "array<string>") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, ["a"], lambda c: X.ngrams(c, 1, 3), "array<string>") == ["a"]
    assert one(spark, ["a", "b", "c"], lambda c: X.ngrams(c, 3, 3), "array<string>") == ["a b c"]
    assert one(spark, [], lambda c: X.ngrams(c, 1, 2), "array<string>") == []


def test_scalars(spark):
    assert one(spark, "12", safe_int) == 12
    assert one(spark, "1.2K", safe_int) == 0
    assert one(spark, "99999999999", safe_int) == 0
    assert one(spark, "x", safe_double) is None
    assert one(spark, " 4.5 ", safe_double) == 4.5
    assert one(spark, "Kü Ödül", slug) == "ku_odul"
    assert one(spark, " Çözüldü ", lambda c: binarise(c, "Çözüldü")) == 1
    assert one(spark, None, lambda c: binarise(c, "Çözüldü")) is None
    assert [one(spark, v, resolution_status) for v in ("Çözülmedi", "Çözüldü", "başka", None)] == [
        "Çözülmedi", "Çözüldü", "Çözüldü", "Bilinmiyor"]
    assert [one(spark, v, band, "double") for v in (5.0, 5.1, 20.1)] == ["green", "amber", "red"]
    assert one(spark, 0.0004, p_label, "double") == "p < 0.001"
    assert one(spark, 0.0396, p_label, "double") == "p = 0.040"
    assert one(spark, 0.7, verdict, "double") == "met"
    assert one(spark, 0.0, direction, "double") == "negative"
    assert one(spark, None, lambda c: clip_upper(c, F.lit(3.0)), "double") is None
    assert one(spark, "", lambda c: absolute_url(c, "https://a")) == ""
    assert one(spark, 1.0, erfc, "double") == pytest.approx(0.15729920705, abs=2e-7)


def test_stop_and_stem_tables(spark):
    docs = spark.createDataFrame(
        [(1, ["kart", "ve", "kart", "iade"], "x"), (2, ["ve"], "y"), (3, [], "z")], "id long, tokens array<string>, note string"
    )
    stops = spark.createDataFrame([("ve",)], "term string")
    for listed in (0, 100):
        got = {r.id: (r.tokens, r.note) for r in K.drop_tokens(docs, "tokens", stops, max_listed=listed).collect()}
        assert got == {1: (["kart", "kart", "iade"], "x"), 2: ([], "y"), 3: ([], "z")}
    stems = spark.createDataFrame([("iade", "iad")], "token string, stem string")
    got = {r.id: r.tokens for r in K.apply_stems(docs, "tokens", stems).collect()}
    assert got == {1: ["kart", "ve", "kart", "iad"], 2: ["ve"], 3: []}


def test_rows_are_kept_apart_without_good_ids(spark):
    rows = [("", ["a", "ve"], "g"), ("", ["b"], "g"), (None, ["ve", "a"], None), (None, ["ve", "a"], None), ("k", None, "g"), ("n", [None, "ve", "a"], "g")]
    docs = spark.createDataFrame(rows, "id string, tokens array<string>, g string")
    stops = spark.createDataFrame([("ve",), (None,)], "term string")
    want = sorted([("", ["a"], "g"), ("", ["b"], "g"), (None, ["a"], None), (None, ["a"], None), ("k", None, "g"), ("n", [None, "a"], "g")], key=str)
    for listed in (0, 100):
        got = K.drop_tokens(docs, "tokens", stops, max_listed=listed)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == want
    stems = spark.createDataFrame([("a", "s")], "token string, stem string")
    assert K.apply_stems(docs, "tokens", stems).count() == len(rows)


def test_stemmer_hook(spark):
    docs = spark.createDataFrame([(["kartlar", "iade"],)], "tokens array<string>")

    def cut(batch):
        return batch.map(lambda ts: [t.removesuffix("lar") for t in ts])

    import pandas as pd
    cut.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    assert docs.select(K.stem_with(F.col("tokens"), cut).alias("t")).first().t == ["kart", "iade"]


def test_sample_prefers_pool(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(20)], "id long, ok boolean")
    pool = [r.id for r in K.stable_sample(df, "id", 3, 42, F.col("ok")).collect()]
    assert len(pool) == 3 and all(i % 5 == 0 for i in pool)
    assert pool == [r.id for r in K.stable_sample(df.repartition(7), "id", 3, 42, F.col("ok")).collect()]
    few = df.withColumn("ok", F.col("id") == 7)
    assert [r.id for r in K.stable_sample(few, "id", 3, 42, F.col("ok")).collect()] == [7]
    none = df.withColumn("ok", F.lit(False))
    assert len(K.stable_sample(none, "id", 3, 42, F.col("ok")).collect()) == 3


def test_stopwords(spark):
    stops = K.build_stopwords({"a": ["Ve", " ve ", ""], "b": ["ve", "ya da"]}, spark)
    assert {(r.category, r.term) for r in stops.collect()} == {("a", "ve"), ("b", "ve"), ("b", "ya da")}
    assert K.default_stopwords(spark).count() > 40
