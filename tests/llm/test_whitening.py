"""Whitening beside plain linear algebra on whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintscope.llm import queries, whitening
from plaintscope.llm.bidiagonal import right_singular

RNG = np.random.default_rng(5)


def brute(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    away = (once * n - sums) / n
    values, directions = np.linalg.eigh(away.T @ away / n)
    values, directions = values[::-1], directions[:, ::-1]
    return n, ((x * n - sums) ** 2).sum(axis=1), (x * n - sums) / n @ (directions / np.sqrt(np.maximum(values, 1e-300))), values / values.sum()


def check(rows, vectors, components):
    n, deviation, whitened, explained = brute(list(vectors.values()))
    at = {k: i for i, k in enumerate(vectors)}
    assert len(rows) == len(vectors) * components
    sign = {}
    for r in rows:
        k, c = at[r.vec_id], r.component - 1
        sign.setdefault(c, np.sign(r.whitened * whitened[k, c]))
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.whitened == pytest.approx(sign[c] * whitened[k, c], rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_is_plain_linear_algebra(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    found = queries.QUERIES["op11_whitening"](spark, small)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), {r.vec_id: r.embedding for r in table}, 16)


def test_unusable_repeated_and_extra(spark):
    vectors = {k: v.tolist() for k, v in enumerate(RNG.normal(size=(300, 5)))}
    vectors |= {k: vectors[7] for k in range(300, 500)}  # one vector many times
    rows = [(k, v, "n") for k, v in vectors.items()]
    bad = [(1000, None, "x"), (1001, [1.0, None, 0.0, 0.0, 0.0], "x"), (1002, [float("nan")] * 5, "x"),
           (1003, [float("inf")] + [0.0] * 4, "x"), (1004, [1.0, 2.0], "x"), (1005, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, Whitening string").withColumn("x", F.lit(1)).repartition(7)
    found = whitening.with_whitening(df)
    assert sorted(found.columns) == ["embedding", "vec_id", "whitening", "x"]
    check(whitening.components(found).collect(), vectors, 5)


def test_no_variance_no_rows_no_dimensions(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], schema)
    rows = whitening.with_whitening(same).collect()
    assert len(rows) == 4 and all((r.whitening.n, r.whitening.deviation, r.whitening.whitened) == (1, 0, []) for r in rows)
    for empty in (spark.createDataFrame([], schema), spark.createDataFrame([(1, None), (None, [])], schema)):
        assert whitening.with_whitening(empty).count() == 0 == whitening.components(whitening.with_whitening(empty)).count()


def test_fewer_directions_than_dimensions(spark):
    flat = RNG.normal(size=(200, 3)) @ RNG.integers(-3, 4, size=(3, 8)) * 0 + np.repeat(RNG.integers(-50, 50, size=(200, 2)), 4, axis=1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(flat.astype(float))], "vec_id long, embedding array<double>")
    rows = whitening.with_whitening(df).collect()
    assert {len(r.whitening.whitened) for r in rows} == {2} and rows[0].whitening.identity_error < 1e-9


def test_entries_beyond_exact_products(spark):
    df = spark.createDataFrame([(k, [k * 1e15, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.whitening for r in whitening.with_whitening(df).collect()}
    assert rows[4].deviation == 0 and rows[0].deviation is None and len(rows[0].whitened) == 1


@pytest.mark.parametrize("kind", ["random", "equal", "graded", "clustered", "singular", "zero"])
def test_singular_vectors(kind):
    size = 40
    left, right = (np.linalg.qr(RNG.normal(size=(size, size)))[0] for _ in range(2))
    values = {"random": RNG.uniform(1, 5, size), "equal": np.ones(size), "graded": np.logspace(0, -9, size), "zero": np.zeros(size),
              "clustered": 1 + 1e-9 * RNG.normal(size=size), "singular": np.repeat([3.0, 1.0, 0.0, 0.0], 10)}[kind]
    matrix = left * values @ right
    found, vectors = right_singular(matrix, size)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    assert np.allclose(found, want, rtol=1e-12, atol=1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-9
    assert np.abs(matrix.T @ matrix @ vectors - vectors * found).max() < 1e-12


@pytest.mark.parametrize("seed", range(12))
def test_vectors_of_repeated_values_hold_nothing_of_others(seed):
    rng, size = np.random.default_rng(seed), 40
    left, right = (np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(2))
    matrix = left * np.repeat([3.0, 1.0, 0.0, 0.0], 10) @ right
    found, vectors = right_singular(matrix, 20)
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12
    assert np.abs(matrix.T @ matrix @ vectors - vectors * found[:20]).max() < 1e-12
