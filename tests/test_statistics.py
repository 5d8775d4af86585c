"""Order statistics, rank tests and ordered rules, in one range and in many."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plaintscope.operators import distribution as D, evaluation as V, ordered as O, profile as P, splits as S
from plaintscope.session import stage

RANGES = [1_000_000, 40]  # rows per range: everything in one, and cut into many


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them; nulls, NaN and ties occur."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        g = "hot" if i % 10 else rng.choice(["a", "b"])
        v = 7.0 if i % 3 == 0 else round(rng.lognormvariate(2, 1), 2)
        v = None if i % 97 == 0 else float("nan") if i % 101 == 0 else v
        rows.append((i, g, v, None if i % 89 == 0 else int(rng.random() < 0.4)))
    rows.append((3000, "empty", None, 1))
    pdf = pd.DataFrame(rows, columns=["id", "g", "v", "y"])
    df = spark.createDataFrame(rows, "id long, g string, v double, y int").repartition(5)
    return df, pdf


def by_group(df, *columns):
    return {r["g"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


@pytest.mark.parametrize("per_range", RANGES)
def test_quantiles(skewed, per_range):
    df, pdf = skewed
    probs = {"q25": 0.25, "median": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}
    got = by_group(D.quantiles_by(df, "g", "v", probs, rows_per_range=per_range), *probs)
    small = by_group(D.quantiles_by(df, "g", "v", probs, bounded=True), *probs)
    for g, part in pdf.groupby("g"):
        want = [part.v.quantile(p) for p in probs.values()]
        if g == "empty":
            assert got[g] == small[g] == (None,) * 5
        else:
            assert got[g] == pytest.approx(want) and small[g] == pytest.approx(want)


@pytest.mark.parametrize("per_range", RANGES)
def test_rank_tests(skewed, per_range):
    df, pdf = skewed
    got = by_group(D.mann_whitney(df, "g", "v", F.col("y") == 1, per_range), "n1", "n0", "u1", "z")
    auc = by_group(D.roc_auc(df, "g", "v", F.col("y") == 1, per_range), "auc")
    down = by_group(D.roc_auc(df.withColumn("v", -F.col("v")), "g", "v", F.col("y") == 1, per_range), "auc")
    for g, part in pdf.dropna(subset=["v", "y"]).groupby("g"):
        r = part.v.rank()
        n1, n0 = int((part.y == 1).sum()), int((part.y == 0).sum())
        u1 = r[part.y == 1].sum() - n1 * (n1 + 1) / 2
        n, t = n1 + n0, part.v.value_counts().to_numpy()
        s = math.sqrt(n1 * n0 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
        z = (max(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / s
        assert got[g][:2] == (n1, n0)
        assert got[g][2:] == pytest.approx((u1, z))
        assert auc[g] == pytest.approx(u1 / (n1 * n0)) and auc[g] + down[g] == pytest.approx(1.0)


@pytest.mark.parametrize("per_range", RANGES)
def test_roc_curve(skewed, per_range):
    df, pdf = skewed
    points = D.roc_curve(df.filter("g = 'hot'"), "g", "v", F.col("y") == 1, per_range).toPandas()
    part = pdf[(pdf.g == "hot")].dropna(subset=["v", "y"])
    c = part.groupby("v").y.agg(c1="sum", n="count").sort_index(ascending=False)
    tps, fps = c.c1.cumsum().to_numpy(), (c.n - c.c1).cumsum().to_numpy()
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    want = sorted(zip(np.r_[0, fps[keep] / fps[-1]], np.r_[0, tps[keep] / tps[-1]]))
    assert np.allclose(sorted(zip(points.fpr, points.tpr)), want)
    area = points.sort_values(["fpr", "tpr"])
    auc = D.roc_auc(df.filter("g = 'hot'"), "g", "v", F.col("y") == 1).first().auc
    assert np.trapezoid(area.tpr, area.fpr) == pytest.approx(auc)


@pytest.mark.parametrize("per_range", RANGES)
def test_running(spark, per_range):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 9)) for g in "aaab" for i in rng.sample(range(10_000), 100)]
    pdf = pd.DataFrame(rows, columns=["g", "o", "w"]).drop_duplicates(["g", "o"]).sort_values(["g", "o"])
    df = stage(spark.createDataFrame(pdf))
    got = O.running(df, "g", "o", sums=["w"], previous=["w"], rows_per_range=per_range).toPandas().sort_values(["g", "o"])
    groups = pdf.groupby("g").w
    assert (got.before_w.to_numpy() == (groups.cumsum() - pdf.w).to_numpy()).all()
    assert got.prev_w.fillna(-1).tolist() == groups.shift().fillna(-1).tolist()
    assert got.total_w.tolist() == groups.transform("sum").tolist()
    seq = O.sequence_index(df, "g", "o", per_range).toPandas().sort_values(["g", "o"])
    assert seq.seq.tolist() == groups.cumcount().tolist()


def test_take_while_and_repeats(spark):
    rows = [("x", 1, "2025-02-03"), ("x", 2, "2025-01-20"), ("x", 3, "2024-12-30"), ("x", 4, "2025-01-05"), ("y", 1, "2025-01-02")]
    df = spark.createDataFrame(rows, "g string, pos int, d string")
    kept = O.take_while(df, "g", [F.col("pos")], F.col("d") < "2025-01-01")
    assert {(r.g, r.pos) for r in kept.collect()} == {("x", 1), ("x", 2), ("y", 1)}
    pages = spark.createDataFrame([("x", i + 1, f) for i, f in enumerate("abbc")], "g string, page int, first_id string")
    for per_range in (1_000_000, 1):
        assert sorted(r.page for r in O.drop_repeats(pages, "g", "page", rows_per_range=per_range).collect()) == [1, 2]


def test_top_per_group_large(spark):
    df = spark.range(5000).withColumn("g", F.lit("hot")).withColumn("v", F.col("id") % 977)
    order = [F.col("v").desc(), F.col("id").asc()]
    big = O.top_per_group(df, "g", order, 1500, ["id"]).select("id", "rank").collect()
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).id.head(1500).tolist()
    assert [i for i, _ in sorted(((r.id, r["rank"]) for r in big), key=lambda x: x[1])] == want


def test_moments_and_boxes(spark):
    rows = [("m", v) for v in (1, 1, 1, 2, 5, 5)] + [("two", 1), ("two", 2), ("flat", 3), ("flat", 3), ("flat", 3)]
    df = spark.createDataFrame(rows, "g string, v int")
    skew = by_group(P.skew_by(df, "g", "v"), "skew")
    assert skew["m"] == pytest.approx(0.8179817965) and skew["two"] is None and skew["flat"] is None
    q = by_group(D.quantiles_by(df, "g", "v", {"m": 0.5, "a": 0.25, "b": 0.75, "p": 0.95}), "m", "a", "b", "p")
    assert q["m"] == (1.5, 1.0, 4.25, 5.0)
    box = spark.createDataFrame([("b", v) for v in (1, 2, 3, 4, 100)], "g string, v int")
    got = D.box_stats(box, "g", "v", 1).first()
    assert (got.q1, got.med, got.q3, got.low_whisker, got.high_whisker, got.outliers) == (2, 3, 4, 1, 4, 1)


def test_histogram(spark):
    df = spark.createDataFrame([("h", v) for v in range(5)] + [("c", 4)] * 3, "g string, v int")
    rows = D.histogram(df, "g", "v", bins=2, clip_p95=False).collect()
    assert {(r.g, r.bin, r.n) for r in rows} == {("h", 0, 2), ("h", 1, 3), ("c", 1, 3)}


@pytest.mark.parametrize("per_range", RANGES)
def test_histogram_keeps_all_rows(skewed, per_range):
    df, pdf = skewed
    got = D.histogram(df, "g", "v", 40, True, per_range).groupBy("g").agg(F.sum("n").alias("n"))
    assert by_group(got, "n") == {g: n for g, n in pdf.groupby("g").v.count().items() if n}


def test_hand_worked_rank_test(spark):
    rows = [(1, v) for v in (5, 4, 5, 3)] + [(0, v) for v in (1, 1, 3, 2)]
    df = spark.createDataFrame([("k", y, v) for y, v in rows], "g string, y int, v int")
    r = D.mann_whitney(df, "g", "v", F.col("y") == 1).first()
    assert (r.u1, r.z, r.p) == pytest.approx((15.5, 2.0578065753, 0.0396087), abs=1e-6) and r.label == "p = 0.040"
    assert D.roc_auc(df, "g", "v", F.col("y") == 1).first().auc == pytest.approx(0.96875)
    single = df.filter("y = 1")
    assert D.roc_auc(single, "g", "v", F.col("y") == 1).first().auc is None
    assert D.mann_whitney(single, "g", "v", F.col("y") == 1).first().z is None


def test_trend(spark):
    df = spark.createDataFrame([("t", f"2025-0{i + 1}", n) for i, n in enumerate((10, 12, 11, 15))] + [("one", "2025-01", 3)],
                               "g string, month string, n int")
    got = by_group(P.monthly_trend(df, "g", "month"), "slope", "intercept")
    assert got == {"t": pytest.approx((1.4, 9.9))}


def test_confusion_and_metrics(spark):
    rows = list(zip((1, 1, 1, 0, 0, 1), (1, 0, 1, 0, 1, 1)))
    df = spark.createDataFrame([("m", a, b) for a, b in rows] + [("never", 1, 0), ("never", 0, 0)], "g string, y int, p int")
    cells = {(r.truth, r.predicted): r.n for r in V.confusion(df.filter("g = 'm'"), "g", "y", "p").collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    m = by_group(V.metrics(df, "g", "y", "p"), "accuracy", "precision", "recall", "f1")
    assert m["m"] == pytest.approx((2 / 3,) * 4)
    assert m["never"][1] == pytest.approx(0.25) and m["never"][2] == m["never"][0]
    report = {r["class"]: r for r in V.class_report(df.filter("g = 'm'"), "g", "y", "p").collect()}
    assert report["1"].support == 4 and report["macro"].f1 == pytest.approx(0.625)


def test_splits(spark):
    rows = [(i, "big" if i % 7 else "small", int(i % 3 == 0)) for i in range(1688)]
    df = spark.createDataFrame(rows, "id long, g string, y int")
    parts = S.stratified_split(df, "id", "y", "g").toPandas()
    assert len(parts) == len(rows) and parts.id.is_unique
    for _, p in parts.groupby("g"):
        assert (p.part == "test").sum() == math.ceil(0.2 * len(p))
        share = p[p.part == "test"].y.mean()
        assert share == pytest.approx(p.y.mean(), abs=0.01)
    again = S.stratified_split(df.repartition(9), "id", "y", "g").toPandas()
    assert set(again[again.part == "test"].id) == set(parts[parts.part == "test"].id)
    folds = S.stratified_folds(df, "id", "y", "g").toPandas()
    sizes = folds.groupby(["g", "y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
    w = {(r.g, r.y): r.weight for r in S.class_weights(df, "y", "g").collect()}
    part = pd.DataFrame(rows, columns=["id", "g", "y"])
    assert w[("big", 1)] == pytest.approx(len(part[part.g == "big"]) / (2 * len(part[(part.g == "big") & (part.y == 1)])))


def test_null_profile_identities(spark):
    rows = [("a", 5.0, "k", None), ("a", None, None, "r"), ("a", float("nan"), "k", "r"), ("b", 1.0, "k", "r")]
    df = spark.createDataFrame(rows, "g string, s double, k string, r string")
    for r in P.null_profile(df, "g", "s", "k", "r").collect():
        assert r.filled + r.n_null == r.total
        assert r.null_pct == pytest.approx(100 * r.n_null / r.total)
    assert by_group(P.null_profile(df, "g", "s", "k", "r"), "n_null")["a"] == 2


@pytest.mark.parametrize("per_range", [1_000_000, 2])
def test_null_group_is_a_group(spark, per_range):
    rows = [(None, i, float(i % 3), i % 2) for i in range(9)] + [("a", i, float(i), i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id int, v double, y int")
    med = by_group(D.quantiles_by(df, "g", "v", {"m": 0.5}, rows_per_range=per_range), "m")
    assert med == {None: 1.0, "a": 1.5}
    assert by_group(D.box_stats(df, "g", "v", per_range), "med") == med
    assert set(by_group(D.roc_auc(df, "g", "v", F.col("y") == 1, per_range), "auc")) == {None, "a"}
    assert sum(r.n for r in D.histogram(df, "g", "v", 3, True, per_range).collect()) == 13
    assert S.stratified_split(df, "id", "y", "g").count() == 13
    assert O.sequence_index(df, "g", "id", per_range).count() == 13
    assert by_group(P.quality_precheck(df, "g", F.col("y") == 1, "v", bounded_score=False), "median") == med
    assert P.gate_groups(df, "g", 9).count() == 9
    kept = O.take_while(df, "g", [F.col("id")], F.col("id") == 2)
    assert kept.count() == 4
