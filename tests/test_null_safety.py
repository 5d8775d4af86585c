"""Null, blank and repeated ids, null groups, and values that are not numbers."""

import os

import pytest
from pyspark.sql import functions as F

from plaintscope.operators import distribution as D, features as E, profile as P, reports as R, scraped as S, splits as L
from plaintscope.session import stage
from plaintscope.sources import complaints as C
from plaintscope.streaming.ingest import ingest_stream


def test_splits_keep_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None if k < 4 else k, k % 2, f"t{k}") for k in range(20)], "id long, y int, t string")
    parts = L.stratified_split(docs, "id", "y").collect()
    assert len(parts) == 20 and sum(r.part == "test" for r in parts) == 4
    folds = L.stratified_folds(docs, "id", "y", folds=5).collect()
    assert sorted(r.fold for r in folds) == sorted([0, 1, 2, 3, 4] * 4)


def test_a_null_group_keeps_its_documents(spark):
    docs = spark.createDataFrame([(1, None, ["a", "b"]), (2, None, ["a"]), (3, "g", ["a"])], "id long, g string, w array<string>")
    vocab = stage(E.vocabulary(docs, "g", "w", 1, 1.0))
    assert E.bag_of_words(docs, "g", "id", "w", vocab).filter("g IS NULL").count() == 3
    weights = stage(E.tfidf_vocabulary(docs, "g", "w", min_df=1))
    assert E.tfidf(docs, "g", "id", "w", weights).filter("g IS NULL").count() == 3


def test_one_class_has_no_p(spark):
    rows = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 1), ("y", 1.0, 1), ("y", 3.0, 0)], "g string, v double, y int")
    got = {r.g: r for r in D.mann_whitney(rows, "g", "v", F.col("y") == 1).collect()}
    assert got["x"].p is None and got["x"].label is None and got["y"].p is not None


def test_missing_views_and_nan_scores(spark):
    rows = spark.createDataFrame(
        [("x", 1, 4.0, "2024-01", "r", 10), ("x", 0, float("nan"), "2024-01", None, 20), ("x", 1, 5.0, "2024-02", "r", None)],
        "g string, y int, s double, month string, reply string, views int")
    charts = R.chart_tables(rows, "g", F.col("y") == 1, "s", "month", "reply", "views", ["s", "views"])
    assert charts["view_boxes"].first().med == 15
    assert {r.s for r in P.score_distribution(rows, "g", "s").collect()} == {4.0, 5.0}
    assert {r.column: r.n_null for r in charts["null_panel"].collect()} == {"s": 1, "views": 1}


def test_one_detail_for_a_row_and_none_for_blank_keys(spark):
    rows = spark.createDataFrame([("u", 1), ("", 2), (None, 3), ("v", 4)], "url string, n int")
    detail = spark.createDataFrame([("u", "b"), ("u", "a"), ("", "z"), (None, "z")], "url string, t string")
    got = sorted((r.n, r.t) for r in S.enrich(rows, detail, "url", {"t": "none"}).collect())
    assert got == [(1, "a"), (2, "none"), (3, "none"), (4, "none")]


def test_an_empty_stage_is_not_passed_over(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/old")
    assert C.load_stage(spark, [f"{tmp_path}/gone", f"{tmp_path}/old"]).count() == 3
    os.mkdir(f"{tmp_path}/broken")
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        C.load_stage(spark, [f"{tmp_path}/broken", f"{tmp_path}/old"])


def test_the_stream_keeps_every_record_without_an_id(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("", 3), ("", 4), (None, 5), (None, 6)], "id string, n int").coalesce(1)
    rows.write.parquet(f"{tmp_path}/in")
    ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", rows.schema).awaitTermination()
    got = [r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == 5 and {3, 4, 5, 6} <= set(got)


@pytest.mark.parametrize("page, want", [
    ('<a class="x" href="/q?a=1&amp;b=2">t</a>', "/q?a=1&b=2"), ("<A HREF='/u'>t</A>", "/u"), ("<a href=/bare class=x>t</a>", "/bare"),
    ('<a data-href="/no">t</a>', "-"), ('<a data-href="/no" href="/yes" href="/later">t</a>', "/yes"), ("<p>none</p>", "-"), ('<a href="">t</a>', ""),
])
def test_attributes_as_a_page_writes_them(spark, page, want):
    from plaintscope.functions.html import extract_attr

    assert spark.createDataFrame([(page,)], "h string").select(extract_attr("h", "a", "href", "-").alias("v")).first().v == want
