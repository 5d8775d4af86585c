"""Evaluation of predictions, and the model grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from plaintscope.catalog import Tables, query, r6
from plaintscope.catalog.features import SPLIT
from plaintscope.functions import text as X
from plaintscope.functions.scalars import verdict
from plaintscope.operators import classify as M, distribution as D, evaluation as V, splits as S

# Truth is `quality`, the prediction under test is `toxic`.
CELLS = """
WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 0) AS n00, count(*) FILTER (quality = 0 AND toxic = 1) AS n01,
                  count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 1 AND toxic = 1) AS n11
           FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY lang),
s AS (SELECT *, n00 + n01 + n10 + n11 AS n, n00 + n01 AS s0, n10 + n11 AS s1,
             coalesce(n00 / nullif(n00 + n10, 0), 0) AS p0, coalesce(n00 / nullif(n00 + n01, 0), 0) AS r0,
             coalesce(n11 / nullif(n11 + n01, 0), 0) AS p1, coalesce(n11 / nullif(n11 + n10, 0), 0) AS r1 FROM c),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM s),
m AS (SELECT lang, n, (n00 + n11) / n AS accuracy, (p0 * s0 + p1 * s1) / n AS "precision", (r0 * s0 + r1 * s1) / n AS recall,
             (f0 * s0 + f1 * s1) / n AS f1 FROM f)
"""


def _predicted(t: Tables):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query("m7_metrics", CELLS + """
SELECT lang, n, round_even(accuracy, 6) AS accuracy, round_even("precision", 6) AS "precision", round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM m
""")
def m7_metrics(t: Tables):
    m = V.metrics(_predicted(t), "lang", "quality", "toxic")
    return m.select("lang", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# Weighted F1 of each stratified fold, then mean and population deviation over the folds.
@query("m12_cv", """
WITH d AS (SELECT lang, doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold FROM d),
c AS (SELECT lang, fold, count(*) FILTER (quality = 0 AND toxic = 0) AS n00, count(*) FILTER (quality = 0 AND toxic = 1) AS n01,
             count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 1 AND toxic = 1) AS n11 FROM r GROUP BY 1, 2),
f AS (SELECT lang, fold, (coalesce(2.0 * n00 / nullif(2 * n00 + n01 + n10, 0), 0) * (n00 + n01)
             + coalesce(2.0 * n11 / nullif(2 * n11 + n01 + n10, 0), 0) * (n10 + n11)) / (n00 + n01 + n10 + n11) AS f1 FROM c)
SELECT lang, round_even(avg(f1), 6) AS cv_mean, round_even(stddev_pop(f1), 6) AS cv_std FROM f GROUP BY lang
""")
def m12_cv(t: Tables):
    folded = S.stratified_folds(_predicted(t).select("doc_id", "lang", "quality", "toxic"), "doc_id", "quality", "lang")
    per_fold = V.metrics(folded, ["lang", "fold"], "quality", "toxic")
    return V.cross_validated(per_fold, "lang").select("lang", r6("cv_mean").alias("cv_mean"), r6("cv_std").alias("cv_std"))


@query("m8_report", CELLS + """
SELECT lang, class, round_even(p, 6) AS "precision", round_even(r, 6) AS recall, round_even(f, 6) AS f1, support FROM (
  SELECT lang, '0' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS support FROM f
  UNION ALL SELECT lang, '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT lang, 'macro', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
  UNION ALL SELECT lang, 'weighted', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM f)
""")
def m8_report(t: Tables):
    r = V.class_report(_predicted(t), "lang", "quality", "toxic")
    return r.select("lang", "class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("m11_confusion", """
WITH g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(truth, predicted))
SELECT lang, truth, predicted, count(doc_id) AS n FROM g
LEFT JOIN (SELECT doc_id, lang, quality AS truth, toxic AS predicted FROM documents JOIN labels USING (doc_id)) USING (lang, truth, predicted)
GROUP BY 1, 2, 3
""")
def m11_confusion(t: Tables):
    return V.confusion(_predicted(t), "lang", "quality", "toxic")


@query("m9_auc", """
WITH d AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
v AS (SELECT lang, n_chars, count(*) AS t, count(*) FILTER (quality = 1) AS c1 FROM d GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid FROM v),
s AS (SELECT lang, sum(c1)::DOUBLE AS n1, (sum(t) - sum(c1))::DOUBLE AS n0, (sum(mid * c1))::DOUBLE AS r1 FROM r GROUP BY lang)
SELECT lang, round_even((r1 - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auc FROM s
""")
def m9_auc(t: Tables):
    return D.roc_auc(_predicted(t), "lang", "n_chars", F.col("quality") == 1).withColumn("auc", r6("auc"))


@query("m10_roc", """
WITH d AS (SELECT lang, n_chars::DOUBLE AS v, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
c AS (SELECT lang, v, count(*) FILTER (quality = 1) AS c1, count(*) FILTER (quality = 0) AS c0 FROM d GROUP BY 1, 2),
s AS (SELECT *, sum(c1) OVER down AS tps, sum(c0) OVER down AS fps, lead(c1) OVER down AS next1, lead(c0) OVER down AS next0,
             row_number() OVER down AS rn, sum(c1) OVER (PARTITION BY lang) AS n1, sum(c0) OVER (PARTITION BY lang) AS n0
      FROM c WINDOW down AS (PARTITION BY lang ORDER BY v DESC))
SELECT lang, v AS threshold, fps / nullif(n0, 0) AS fpr, tps / nullif(n1, 0) AS tpr FROM s
WHERE rn = 1 OR next1 IS NULL OR next1 <> c1 OR next0 <> c0
UNION ALL SELECT DISTINCT lang, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM c
""")
def m10_roc(t: Tables):
    return D.roc_curve(_predicted(t), "lang", "n_chars", F.col("quality") == 1)


# Languages by model; only model `toxic` has results, the other shows 0.
@query("j6_matrix", CELLS + """
, g AS (SELECT lang, model FROM (SELECT DISTINCT lang FROM documents), (VALUES ('toxic'), ('untrained')) v(model))
SELECT lang, model, coalesce(round_even(accuracy, 6), 0) AS accuracy, coalesce(round_even(f1, 6), 0) AS f1
FROM g LEFT JOIN (SELECT lang, 'toxic' AS model, accuracy, f1 FROM m) USING (lang, model)
""")
def j6_matrix(t: Tables):
    m = V.metrics(_predicted(t), "lang", "quality", "toxic").withColumn("model", F.lit("toxic"))
    models = F.explode(F.array(F.lit("toxic"), F.lit("untrained"))).alias("model")
    combos = t.documents.select("lang").distinct().select("lang", models)
    w = V.metric_matrix(m, ["lang", "model"], ["accuracy", "f1"], combos)
    return w.select("lang", "model", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"))


@query("m15_matrix", CELLS + """
SELECT lang, 'toxic' AS model, round_even(accuracy, 6) AS accuracy, round_even("precision", 6) AS "precision",
       round_even(recall, 6) AS recall, round_even(f1, 6) AS f1 FROM m
""")
def m15_matrix(t: Tables):
    m = V.metrics(_predicted(t), "lang", "quality", "toxic").withColumn("model", F.lit("toxic"))
    names = ["accuracy", "precision", "recall", "f1"]
    w = V.metric_matrix(m, ["lang", "model"], names)
    return w.select("lang", "model", *[r6(c).alias(c) for c in names])


@query("f21_verdict", CELLS + "SELECT lang, CASE WHEN accuracy >= 0.7 THEN 'met' ELSE 'not met' END AS verdict FROM m")
def f21_verdict(t: Tables):
    m = V.metrics(_predicted(t), "lang", "quality", "toxic")
    return m.select("lang", verdict("accuracy").alias("verdict"))


def labelled_grid(t: Tables, **options):
    docs = t.texts("lang").join(t.labels, "doc_id").select(
        "lang", "doc_id", "quality", X.feature_tokens("text").alias("words")
    )
    return M.train_grid(docs, "lang", "doc_id", "quality", "words", **options)


# Test rows of each group that has enough labelled documents of both classes.
HELD = f"""
WITH d AS (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)
           WHERE quality IS NOT NULL AND len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) > 0
           QUALIFY count(*) OVER (PARTITION BY lang) >= 50 AND min(quality) OVER (PARTITION BY lang) < max(quality) OVER (PARTITION BY lang)),
{SPLIT.split("IS NOT NULL),", 1)[1].strip()},
h AS (SELECT lang AS group_key, model, doc_id, quality AS truth FROM r JOIN t USING (lang, quality),
             (VALUES ('logistic_regression'), ('random_forest'), ('linear_svm')) v(model) WHERE rank < n_test)
"""


# What holds for any solver: test rows by class, and values that every row must keep to.
@query("m14_grid", HELD + """
SELECT group_key, model, count(*) FILTER (truth = 0) AS n0, count(*) FILTER (truth = 1) AS n1, TRUE AS recall_is_accuracy,
       TRUE AS in_range, TRUE AS cross_validated FROM h GROUP BY 1, 2
""")
def m14_grid(t: Tables):
    results = labelled_grid(t)
    keys = ["group_key", "model"]
    tested = reduce(DataFrame.unionByName, [p for r in results for p in r.predictions])
    sizes = tested.groupBy(*keys).agg(F.count_if(F.col("truth") == 0).alias("n0"), F.count_if(F.col("truth") == 1).alias("n1"))
    shares = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "auc")]
    return sizes.join(M.leaderboard(results), keys, "left").select(
        *keys, "n0", "n1", (F.abs(F.col("recall") - F.col("accuracy")) < 1e-9).alias("recall_is_accuracy"),
        reduce(lambda a, b: a & b, shares).alias("in_range"),
        (F.col("cv_mean").between(0, 1) & (F.col("cv_std") >= 0)).alias("cross_validated"),
    )


# Twenty terms of each model, heaviest first. Folds do not change these models.
@query("m13_features", HELD + """
SELECT group_key, model, CAST(rank AS INTEGER) AS rank, TRUE AS falling FROM (SELECT DISTINCT group_key, model FROM h), range(1, 21) x(rank)
""")
def m13_features(t: Tables):
    tops = [
        M.feature_top(model, fitted.terms).withColumns({"group_key": F.lit(fitted.group), "model": F.lit(name)})
        for fitted in labelled_grid(t, folds=0) for name, model in fitted.models.items()
    ]
    order = Window.partitionBy("group_key", "model").orderBy(F.col("importance").desc(), "term")
    before = F.lag("importance").over(order)
    return reduce(DataFrame.unionByName, tops).select(
        "group_key", "model", F.row_number().over(order).alias("rank"),
        (F.coalesce(F.col("importance") <= before, F.lit(True)) & (F.col("importance") == F.abs("signed"))).alias("falling"),
    )


# Every test row is scored once by every model; the label is the side of the score.
@query("m6_score", HELD + "SELECT group_key, model, doc_id, truth::INTEGER AS truth, TRUE AS scored FROM h")
def m6_score(t: Tables):
    rows = reduce(DataFrame.unionByName, [p for fitted in labelled_grid(t, folds=0) for p in fitted.predictions])
    margin = F.col("model") == "linear_svm"
    side = F.when(F.col("score") > F.when(margin, 0.0).otherwise(0.5), 1).otherwise(0)
    fits = (side == F.col("predicted")) & (margin | F.col("score").between(0, 1))
    return rows.select("group_key", "model", "doc_id", "truth", fits.alias("scored"))


# The label follows from one word of the name: every solver must find it in every group.
@query("m3_planted", """
SELECT group_key, model, TRUE AS found FROM (SELECT DISTINCT 'g' || p_partkey % 2 AS group_key FROM part), (VALUES ('logistic_regression'), ('random_forest'), ('linear_svm')) v(model)
""")
def m3_planted(t: Tables):
    label = (F.col("p_size") % 2).cast("int")
    told = F.when(label == 1, "solved").otherwise("open")
    group = F.concat(F.lit("g"), (F.col("p_partkey") % 2).cast("string")).alias("g")
    docs = t.part.select(group, "p_partkey", label.alias("y"), F.concat(F.split("p_name", " "), F.array(told)).alias("words"))
    results = M.train_grid(docs, "g", "p_partkey", "y", "words", min_docs=10, trees=30, depth=8, folds=0)
    board = M.leaderboard(results)
    return board.select("group_key", "model", ((F.col("accuracy") > 0.95) & (F.col("auc") > 0.95)).alias("found"))
