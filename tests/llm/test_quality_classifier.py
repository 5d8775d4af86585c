import zlib

import numpy as np
import pytest

from plaintscope.llm import quality_classifier as qc, queries


def test_held_out_accuracy(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op8_quality_classifier"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    lied = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.quality.score for r in qc.with_quality(docs, labels).collect()}
    b = {r.doc_id: r.quality.score for r in qc.with_quality(docs.selectExpr("doc_id", "text", "'x' AS lang", "1 AS quality"), lied).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_fit_is_that_of_the_plain_equations(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.normal(size=len(qc.STATISTICS)))) for k in range(600)]
    measured = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} double" for c in qc.STATISTICS)).repartition(3)
    measured = measured.selectExpr("doc_id", f"struct({', '.join(qc.STATISTICS)}) AS statistics")
    labels = spark.createDataFrame([(r[0], int(r[1] + r[2] ** 2 > 0.5)) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = qc.fit(measured, labels)
    folds = {r.doc_id: (r.held, r.cal) for r in labels.dropna().selectExpr(
        "doc_id", "crc32(CAST(doc_id AS STRING)) % 3 = 1 AS held", f"pmod(xxhash64(doc_id), {qc.CALIBRATION_FOLD}) = 0 AS cal").collect()}
    use = [r for r in rows if not folds[r[0]][0] and not folds[r[0]][1]]
    x, y = np.array([r[1:] for r in use]), np.array([float(r[1] + r[2] ** 2 > 0.5) for r in use])
    z = model.features(x)
    weights = np.linalg.solve(z.T @ z + qc.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(weights, model.weights, atol=1e-6)
    assert np.all(np.diff(model.share) >= 0)


def test_random_features_approximate_the_kernel():
    one = np.ones(len(qc.STATISTICS))
    model = qc.Model(0 * one, one, np.zeros(qc.FEATURES + 1), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(1).normal(size=(40, len(qc.STATISTICS)))
    z = model.features(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * qc.WIDTH ** 2))).max() < 0.3


def test_pooling():
    raw, share = qc.pooled([(0.0, 10, 1), (0.1, 10, 5), (0.2, 10, 3), (0.9, 10, 10)])
    assert len(raw) == 3 and list(share) == sorted(share) and share[1] == pytest.approx(8.5 / 21)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "no id"), (5, "w " * 60_000)]
    docs = spark.createDataFrame([(k, t, 2, "q") for k, t in rows], "doc_id long, text string, label int, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality.score for r in qc.with_quality(docs, none).collect()] == [0.5] * 6
    few = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = qc.with_quality(docs, few).collect()
    assert len(got) == 6 and all(0 <= r.quality.score <= 1 for r in got)
    assert qc.with_quality(docs.limit(0), few).count() == 0
    assert qc.keep_good(docs, few).columns == docs.columns
