"""HTML, sources and sinks, streaming restart, and the whole analysis on a made-up set."""

import random

import pytest
from pyspark.sql import functions as F

from plaintscope.functions import fixed_values as fv, html as H
from plaintscope.operators import scraped as S
from plaintscope.operators.categories import category_counts, first_seen_categories, merged_categories, split_keywords, top_categories
from plaintscope.plans import flow
from plaintscope.sources import complaints as C, sinks
from plaintscope.streaming.ingest import ingest_stream

CARD = """<html><article class="card-v2 big" data-id=" 17 " data-upvoter-count="x"><h2 class="complaint-title"><a href="/q/1">
 Kart <b>iadesi</b></a></h2><span class="username">ali</span><div class="post js-tooltip time">5 Şubat 00:14</div>
<span class="js-view-count">41</span><a class="sv-model-button">#Kredi </a><a class="sv-model-button">Hesap</a>
<a class="complaint-description">uzun metin <span class="ellipsis-text">...</span></a></article>
<article class="card-v2"><h2 class="complaint-title">Başlık</h2></article><article class="other">no</article></html>"""


def test_list_cards(spark):
    pages = spark.createDataFrame([(CARD, "Op")], "html string, op string")
    rows = S.list_cards(pages, "html", "op", "https://a.example", F.lit("2026-02-10").cast("date")).orderBy("pos").collect()
    a, b = rows
    assert (a.id, a.title, a.url, a.username) == ("17", "Kartiadesi", "https://a.example/q/1", "ali")
    assert (str(a.date), a.view_count, a.upvote_count) == ("2026-02-05", 41, 0)
    assert (a.keywords, a.description_preview) == ("Kredi, Hesap", "uzun metin")
    assert (b.id, b.title, b.url, b.date, b.keywords, b.view_count) == ("", "Başlık", "", None, "", 0)


def test_detail_and_enrich(spark):
    html = ('<div class="complaint-detail-description"><p> bir </p><!-- x --><script>y</script><p>iki &amp; üç</p></div>'
            '<section class="complaint-reply-container">yanıt</section><div class="solved-badge ga">Çözülmedi</div><b class="rate-num">4.5</b>'
            '<span class="rate-num">4</span>')
    pages = spark.createDataFrame([("u1", html), ("u2", "<p>bos</p>")], "url string, html string")
    detail = S.detail_fields(pages, "html", "url")
    rows = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "url string, n int")
    got = {r.n: r for r in S.enrich(rows, detail, "url", S.DETAIL_DEFAULTS).collect()}
    assert (got[1].full_text, got[1].company_reply, got[1].is_resolved, got[1].satisfaction) == ("bir\niki & üç", "yanıt", "Çözülmedi", 4.5)
    for n in (2, 3):
        assert (got[n].full_text, got[n].company_reply, got[n].is_resolved, got[n].satisfaction) == ("", "", "Bilinmiyor", None)


@pytest.mark.parametrize("html, text", [
    ('<div class="d"><div>a<div>b</div></div> c <br/></div><div>no</div>', "a|b|c"),
    ('<DIV class="x d y">a<div/>b</DIV>c', "a|b"),
    ('<p class="d">open <b>end', "open|end"),
    ('<p class="d"></p><p class="d">x</p>', ""),
    ('<!-- <p class="d">x</p> --><p class="dd">y</p>', None),
    ("", None),
    (None, None),
])
def test_nested_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(H.nested_text("html", "d", "|").alias("t")).first().t == text


def test_selectors_and_inventory(spark):
    html = '<div class="x y">one</div><p class="answer-box y">two</p><script class="no-answer"></script>'
    df = spark.createDataFrame([(html,)], "html string")
    name, text = H.first_match("html", [("a", "div", "answer"), ("b", "div", "y"), ("c", "p", None)])
    assert df.select(name.alias("n"), text.alias("t")).first() == ("b", "one")
    assert {tuple(r) for r in S.class_inventory(df, "html", ["answer", "y"]).collect()} == {("y", 2, "one"), ("answer-box", 1, "two")}


def test_categories(spark):
    mapping = spark.createDataFrame([("v", "Gold Kart", "Kredi Kartı"), ("v", "Kredi", "Kredi")], "g string, keyword string, category string")
    df = spark.createDataFrame([("v", 1, "Zor, Gold Kart, Kredi,, Kredi "), ("v", 2, None), ("w", 1, "Gold Kart")], "g string, id int, kw string")
    counts = category_counts(df, mapping, "g", split_keywords("kw"))
    assert {(r.g, r.category, r.n) for r in counts.collect()} == {("v", "Kredi", 2), ("v", "Kredi Kartı", 1), ("v", "Zor", 1), ("w", "Gold Kart", 1)}
    names = lambda d: [r.category for r in d.filter("g = 'v'").orderBy("rank").collect()]
    assert names(top_categories(counts, "g")) == ["Kredi", "Kredi Kartı", "Zor"]
    assert names(first_seen_categories(df, mapping, "g", split_keywords("kw"), "id")) == ["Kredi", "Zor", "Kredi Kartı"]
    assert [tuple(r) for r in merged_categories(mapping, "g").collect()] == [("v", "Kredi Kartı", ["Gold Kart"])]


def test_csv_shape(spark, tmp_path):
    path = tmp_path / "c.csv"
    header = ",".join(fv.COMPLAINT_COLUMNS)
    path.write_text(
        "﻿" + header + "\n"
        'Op,007,2025-02-30,ham,u,"t, ""q""","satır bir\nsatır iki",,Çözüldü,5.0,,"A, B",3,1,http://x\n'
        "Op,8,2025-01-02,ham,u,t,metin,yanıt,Bilinmiyor,,,,0,0,\n", encoding="utf-8")
    rows = C.read_complaints(spark, str(path)).orderBy("id").collect()
    assert len(rows) == 2
    assert (rows[0].operator, rows[0].id, rows[0].date, rows[0].full_text, rows[0].title) == ("Op", "007", None, "satır bir\nsatır iki", 't, "q"')
    assert rows[0].company_reply is None and rows[1].company_reply == "yanıt" and rows[1].satisfaction is None and str(rows[1].date) == "2025-01-02"


def test_terms_and_groups(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "t string")
    sinks.write_terms(df, str(tmp_path / "terms"))
    assert [r.term for r in sinks.read_terms(spark, str(tmp_path / "terms")).collect()] == ["a", "b"]
    sinks.write_by_group(spark.createDataFrame([("x", 1), ("y", 2)], "g string, n int"), "g", str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).filter("g = 'y'").first().n == 2
    with pytest.raises(FileNotFoundError):
        C.load_stage(spark, [str(tmp_path / "none")])


def test_stream_restart(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    frame = lambda ids: spark.createDataFrame([(str(i), f"t{i}") for i in ids], "id string, v string")
    schema = frame([0]).schema
    frame(range(10)).write.parquet(src)
    ingest_stream(spark, src, out, ckpt, schema).awaitTermination()
    frame(range(5, 15)).write.mode("append").parquet(src)
    ingest_stream(spark, src, out, ckpt, schema).awaitTermination()
    ids = sorted(int(r.id) for r in spark.read.parquet(out).collect())
    assert ids == list(range(15))


def test_whole_analysis(spark, tmp_path):
    rng = random.Random(4)
    paths = {}
    for g in ("v", "k"):
        rows = []
        for i in range(90):
            ok = i % 3 == 0
            words = [rng.choice(["kart", "aidat", "limit", "ekstre"] if i % 2 else ["havale", "para", "hesap", "transfer"]) + str(rng.randint(0, 3)) for _ in range(14)]
            text = " ".join(words) + (" Teşekkür ettim" if ok else " Çözülmedi hâlâ!")
            rows.append((g, f"{g}{i}", f"2025-{i % 6 + 1:02d}-03", "", "u", "t", text, "yanıt" if i % 4 else None,
                         "Çözüldü" if ok else "Bilinmiyor", (5.0 if ok else 1.0) if i % 5 else None, "", "Kart, Para" if i % 2 else "Para", i, 0, ""))
        df = spark.createDataFrame(rows, C.COMPLAINT_SCHEMA)
        paths[g] = str(tmp_path / g)
        sinks.write_report(df, paths[g])
    out = str(tmp_path / "out")
    raw = flow.collect(spark, paths, {"v": "Banka V"}, f"{out}/raw")
    assert raw.count() == 180 and {r.group_name for r in raw.select("group_name").distinct().collect()} == {"Banka V", "k"}
    mapping = spark.createDataFrame([("v", "Kart", "Kredi Kartı")], "group_key string, keyword string, category string")
    tables = flow.profile(raw, f"{out}/reports", mapping)
    nulls = {r.group_key: r for r in tables["null_report"].collect()}
    assert nulls["v"].total == 90 and nulls["v"].filled + nulls["v"].n_null == 90 and nulls["v"].null_pct == pytest.approx(20.0)
    assert spark.read.option("header", True).csv(f"{out}/reports/summary").count() == 2
    cleaned = flow.clean(raw, f"{out}/clean", ["ettim"], locale="tr")
    assert cleaned.count() == 180 and not cleaned.filter(F.array_contains("tokens", "ettim")).count()
    topics = flow.find_topics(cleaned, f"{out}/topics", ["v", "k", "nobody"], ks=(2, 3), passes=1, final_passes=2)
    assert topics["counts"].agg(F.sum("n")).first()[0] == 180
    stored = sinks.read_topic_json(spark, f"{out}/topics/topics_json").collect()
    for r in stored:
        assert r.coherence_max == max(r.coherence.values()) and r.coherence[str(r.optimal_k)] == r.coherence_max
        assert len(r.topics) == r.optimal_k and r.n_docs == 90
    board, results = flow.classify(cleaned, f"{out}/models", trees=5, depth=3, folds=0, max_iter=20)
    assert board.count() == 6
    final = flow.compare(cleaned, board, f"{out}/compare", results, topics["counts"])
    report = {r.id: r.result for r in final["hypotheses"].collect()}
    assert set(report) == {"H1", "H2", "H3", "H4", "H5"} and "difference=4.000 (positive)" in report["H5"] and len(report["H3"]) <= 400
    assert final["kpi"].count() == 2
