"""Per-group profiles: counts, rates, null shares, summaries, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintscope.functions.scalars import band, direction, null_if_nan, rate, skew_flag
from plaintscope.operators.distribution import quantiles_by, skewness
from plaintscope.session import cols, join_groups, stage


def count_by(df: DataFrame, groups: str | list[str], value: str) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_filled"))


def rate_by(df: DataFrame, groups: str | list[str], condition: Column) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("n_pos"), rate(condition).alias("pct")
    )


def mean_by(df: DataFrame, groups: str | list[str], value: str) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(F.avg(null_if_nan(F.col(value).cast("double"))).alias("mean"))


def skew_by(df: DataFrame, groups: str | list[str], value: str) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(skewness(value).alias("skew")).withColumn("warn", skew_flag("skew"))


def value_counts(df: DataFrame, keys: str | list[str]) -> DataFrame:
    return df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("n"))


def pivot_counts(df: DataFrame, index: str, column: str, values: list[str], fill: bool = False) -> DataFrame:
    """One column per value. Values are given, so no extra job looks for them."""
    wide = df.groupBy(index).agg(
        *[F.nullif(F.count_if(F.col(column) == v), F.lit(0)).alias(v) for v in values]
    )
    return wide.fillna(0, subset=values) if fill else wide


def class_balance(df: DataFrame, groups: str | list[str], label: str) -> DataFrame:
    """Size and share of both classes among labelled rows."""
    positive = F.col(label) == 1
    return df.filter(F.col(label).isNotNull()).groupBy(*cols(groups)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("n_pos"),
        F.count_if(~positive).alias("n_neg"),
        rate(positive).alias("pct"),
    )


def class_gap(df: DataFrame, groups: str | list[str], label: str, value: str) -> DataFrame:
    """Mean by class, their difference and its direction; a missing class gives nulls."""
    v = null_if_nan(F.col(value).cast("double"))
    means = df.groupBy(*cols(groups)).agg(
        F.avg(F.when(F.col(label) == 1, v)).alias("mean1"),
        F.avg(F.when(F.col(label) == 0, v)).alias("mean0"),
    )
    return means.withColumn("diff", F.col("mean1") - F.col("mean0")).withColumn("direction", direction("diff"))


def null_panel(df: DataFrame, groups: str | list[str], columns: list[str]) -> DataFrame:
    """Long form: one row per group and column with its null count, share and band."""
    groups, kinds = cols(groups), dict(df.dtypes)
    missing = {c: F.isnan(c) | F.col(c).isNull() if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns}
    wide = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(missing[c]).alias(c) for c in columns]
    )
    long = wide.unpivot([*groups, "total"], columns, "column", "n_null")
    return long.withColumn("null_pct", F.lit(100.0) * F.col("n_null") / F.col("total")).withColumn(
        "band", band("null_pct")
    )


def null_profile(df: DataFrame, groups: str | list[str], score: str, keywords: str, reply: str,
                 bounded_score: bool = True) -> DataFrame:
    """Completeness of score, keywords and reply per group, with the score's median."""
    groups = cols(groups)
    s = null_if_nan(F.col(score).cast("double"))
    profile = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(s).alias("filled"),
        F.count_if(s.isNull()).alias("n_null"),
        rate(s.isNull()).alias("null_pct"),
        F.count_if(F.col(keywords).isNull()).alias("keywords_null"),
        rate(F.col(keywords).isNull()).alias("keywords_null_pct"),
        F.count(reply).alias("replies"),
        rate(F.col(reply).isNotNull()).alias("reply_pct"),
        *(_percentiles(score, {"median": 0.5}) if bounded_score else []),
    )
    return profile if bounded_score else _with_quantiles(profile, df, groups, score, {"median": 0.5})


def _with_quantiles(base: DataFrame, df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Join exact quantiles to a table with one row per group, by way of a value table."""
    return join_groups(base, stage(quantiles_by(df, groups, value, probs)), groups, "left")


def _percentiles(value: str, probs: dict[str, float]) -> list[Column]:
    """Exact quantiles of a column of few distinct values, inside the aggregate at hand."""
    return [F.percentile(null_if_nan(F.col(value).cast("double")), F.lit(p)).alias(n) for n, p in probs.items()]


def summary(df: DataFrame, groups: str | list[str], resolved: Column, score: str, words: str, views: str,
            bounded_score: bool = True) -> DataFrame:
    """Eight headline numbers per group. The plain ones are one pass; medians and
    quartiles are exact."""
    groups = cols(groups)
    s = null_if_nan(F.col(score).cast("double"))
    probs = {"med_score": 0.5, "q25": 0.25, "q75": 0.75}
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rate(resolved).alias("resolved_pct"),
        rate(s.isNull()).alias("null_pct"),
        F.avg(words).alias("mean_words"),
        *(_percentiles(score, probs) if bounded_score else []),
    )
    if not bounded_score:
        base = _with_quantiles(base, df, groups, score, probs)
    return _with_quantiles(base, df, groups, views, {"med_views": 0.5})


def quality_precheck(df: DataFrame, groups: str | list[str], resolved: Column, score: str,
                     bounded_score: bool = True) -> DataFrame:
    """First look at a source: sizes, rates, median, skewness and a warning on skew."""
    groups = cols(groups)
    s = null_if_nan(F.col(score).cast("double"))
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(resolved).alias("n_pos"),
        (F.count(F.lit(1)) - F.count_if(resolved)).alias("n_other"),
        rate(resolved).alias("pct"),
        F.count_if(s.isNull()).alias("n_null"),
        rate(s.isNull()).alias("null_pct"),
        skewness(score).alias("skew"),
        *(_percentiles(score, {"median": 0.5}) if bounded_score else []),
    )
    if not bounded_score:
        base = _with_quantiles(base, df, groups, score, {"median": 0.5})
    return base.withColumn("warn", skew_flag("skew"))


def score_distribution(df: DataFrame, groups: str | list[str], score: str, bounded_score: bool = True) -> DataFrame:
    """Count per score value, beside the group's median and null share."""
    groups = cols(groups)
    if dict(df.dtypes)[score] in ("double", "float"):
        df = df.withColumn(score, null_if_nan(F.col(score)))
    counts = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("n"))
    medians = _percentiles(score, {"median": 0.5}) if bounded_score else []
    per_group = df.groupBy(*groups).agg(rate(F.col(score).isNull()).alias("null_pct"), *medians)
    per_group = stage(per_group if bounded_score else _with_quantiles(per_group, df, groups, score, {"median": 0.5}))
    return join_groups(counts.filter(F.col(score).isNotNull()), per_group, groups)


def kpi_table(df: DataFrame, groups: str | list[str], resolved: Column, score: str, words: str, views: str,
              bounded_score: bool = True) -> DataFrame:
    groups = cols(groups)
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rate(resolved).alias("resolved_pct"),
        F.avg(null_if_nan(F.col(score).cast("double"))).alias("mean_score"),
        F.avg(null_if_nan(F.col(words).cast("double"))).alias("mean_words"),
        F.avg(null_if_nan(F.col(views).cast("double"))).alias("mean_views"),
        *(_percentiles(score, {"med_score": 0.5}) if bounded_score else []),
    )
    return base if bounded_score else _with_quantiles(base, df, groups, score, {"med_score": 0.5})


def date_span(df: DataFrame, date: str, groups: str | list[str] = ()) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def cleaning_stats(df: DataFrame, groups: str | list[str], before: Column, after: Column,
                   cleaned: Column, longer_than: int = 3) -> DataFrame:
    """What cleaning did: mean words before and after, blank texts, rows past the gate."""
    return df.groupBy(*cols(groups)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(before).alias("words_before"),
        F.avg(after).alias("words_after"),
        F.count_if(F.trim(cleaned) == "").alias("n_blank"),
        F.count_if(F.length(F.trim(cleaned)) > longer_than).alias("n_kept"),
    )


def ingest_summary(df: DataFrame, group: str, status: str, score: str, date: str) -> DataFrame:
    """Long table of what arrived: totals, rows per group and per status, mean, dates.

    One grouping-sets pass; nothing is collected.
    """
    scored = null_if_nan(F.col(score).cast("double"))
    d = F.col(date).cast("date")
    cube = df.select(F.col(group).alias("g"), F.col(status).alias("s"), scored.alias("v"), d.alias("d")).groupingSets(
        [[], [F.col("g")], [F.col("s")]], F.col("g"), F.col("s")
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean_score"),
        F.min("d").alias("first_date"),
        F.max("d").alias("last_date"),
    )
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "group").otherwise("status")
    return cube.select(
        level.alias("level"),
        F.when(F.col("gid") == 1, F.col("g")).when(F.col("gid") == 2, F.col("s")).alias("key"),
        "n", "mean_score", "first_date", "last_date",
    )


def monthly_counts(df: DataFrame, groups: str | list[str], month: str) -> DataFrame:
    return df.filter(F.col(month).isNotNull()).groupBy(*cols(groups), month).agg(F.count(F.lit(1)).alias("n"))


def monthly_trend(counts: DataFrame, groups: str | list[str], month: str, min_points: int = 2) -> DataFrame:
    """Straight line through the monthly counts, x = 0, 1, 2 ... in month order.

    The window runs over one row per group and calendar month, which the calendar bounds.
    """
    groups = cols(groups)
    points = sequence_of_months(counts, groups, month)
    n, x = F.col("n").cast("double"), F.col("seq").cast("double")
    return (
        points.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.regr_slope(n, x).alias("slope"),
            F.regr_intercept(n, x).alias("intercept"),
        )
        .filter(F.col("months") >= min_points)
    )


def sequence_of_months(counts: DataFrame, groups: list[str], month: str) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(month)
    return counts.withColumn("seq", F.row_number().over(w) - 1)


def trend_points(counts: DataFrame, groups: str | list[str], month: str) -> DataFrame:
    """The monthly counts with the fitted line's value at each month."""
    groups = cols(groups)
    lines = monthly_trend(counts, groups, month)
    points = join_groups(sequence_of_months(counts, groups, month), stage(lines), groups)
    return points.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("seq")).select(
        *groups, month, "n", "fitted"
    )


def argmax(df: DataFrame, groups: str | list[str], key: str, score: str) -> DataFrame:
    """Key with the largest score; among equals the smallest key."""
    best = F.max_by(key, F.struct(F.col(score), -F.col(key)))
    return df.groupBy(*cols(groups)).agg(best.alias(key), F.max(score).alias(score))


def gate_groups(df: DataFrame, groups: str | list[str], at_least: int) -> DataFrame:
    """Rows of groups with at least `at_least` rows."""
    groups = cols(groups)
    big = stage(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= at_least))
    return join_groups(df, big.select(*groups), groups, "left_semi")
