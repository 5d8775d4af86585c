"""Exact order statistics and rank tests over a pre-aggregated value table.

Everything here starts from `value_table`: one row per (group, distinct value) with its
multiplicity. Ties collapse in the map-side combine, so a value that holds a third of
all rows costs one row, and ranks follow from running sums (`ordered.running`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.functions.scalars import clip_upper, erfc, null_if_nan, p_label
from plaintscope.operators.ordered import ROWS_PER_RANGE, running
from plaintscope.session import cols, join_groups, stage


def value_table(df: DataFrame, groups: str | list[str], value: str, positive: Column | None = None) -> DataFrame:
    """Staged (group, value, n[, c1, c0]); a null value row keeps groups with no values.

    `n` counts rows with that value and is 0 on the null row, whose rows are in
    `n_null`. With `positive`, `c1`/`c0` split `n` by the label; a null label counts in
    neither.
    """
    groups = cols(groups)
    base = df.select(*groups, null_if_nan(F.col(value).cast("double")).alias("value"),
                     *([positive.alias("__y")] if positive is not None else []))
    present = F.col("value").isNotNull()
    counts = [
        F.count_if(present).alias("n"),
        F.count_if(~present).alias("n_null"),
    ]
    if positive is not None:
        counts += [
            F.count_if(present & F.col("__y")).alias("c1"),
            F.count_if(present & ~F.col("__y")).alias("c0"),
        ]
    return stage(base.groupBy(*groups, "value").agg(*counts))


def _at_rank(p: float) -> Column:
    """Aggregate over ranked value rows: the p-quantile, linear between neighbours."""
    place = (F.col("total_n") - 1) * F.lit(p)
    low, high = F.floor(place), F.ceil(place)

    def pick(rank: Column) -> Column:
        hit = (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    fraction = F.max(place - low)
    return pick(low) + (pick(high) - pick(low)) * fraction


def ranked(table: DataFrame, groups: str | list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    return running(table, groups, "value", sums=["n"], rows_per_range=rows_per_range)


def quantiles_of(
    table: DataFrame, groups: str | list[str], probs: dict[str, float], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Exact quantiles per group from a value table, one row per group."""
    rows = ranked(table, groups, rows_per_range)
    return rows.groupBy(*cols(groups)).agg(*[_at_rank(p).alias(name) for name, p in probs.items()])


def quantiles_by(
    df: DataFrame,
    groups: str | list[str],
    value: str,
    probs: dict[str, float],
    bounded: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact quantiles per group.

    `bounded=True` says the column has a small fixed domain (a 1-to-5 rating): Spark's
    `percentile` then holds a handful of distinct values per group. Any other column goes
    through the value table, where no task holds a whole group.
    """
    if bounded:
        return df.groupBy(*cols(groups)).agg(
            *[F.percentile(null_if_nan(F.col(value).cast("double")), F.lit(p)).alias(n) for n, p in probs.items()]
        )
    return quantiles_of(value_table(df, groups, value), groups, probs, rows_per_range)


def median_by(df: DataFrame, groups: str | list[str], value: str, bounded: bool = False) -> DataFrame:
    return quantiles_by(df, groups, value, {"median": 0.5}, bounded)


def p95_by(df: DataFrame, groups: str | list[str], value: str) -> DataFrame:
    return quantiles_by(df, groups, value, {"p95": 0.95})


def box_stats(df: DataFrame, groups: str | list[str], value: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Median, quartiles, whiskers at the outermost points within 1.5 IQR, outlier count."""
    groups = cols(groups)
    table = value_table(df, groups, value)
    quartiles = stage(quantiles_of(table, groups, {"q1": 0.25, "med": 0.5, "q3": 0.75}, rows_per_range))
    joined = join_groups(table, quartiles, groups)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*groups).agg(
        F.first("q1").alias("q1"),
        F.first("med").alias("med"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def clip_to_p95(df: DataFrame, groups: str | list[str], value: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Value table with values above the group's p95, cut to a whole number, set to it."""
    groups = cols(groups)
    table = value_table(df, groups, value)
    p95 = quantiles_of(table, groups, {"p95": 0.95}, rows_per_range)
    high = stage(p95.withColumn("p95", F.col("p95").cast("bigint").cast("double")))
    joined = join_groups(table, high, groups)
    return joined.withColumn("clipped", clip_upper("value", F.col("p95")))


def histogram(
    df: DataFrame, groups: str | list[str], value: str, bins: int = 40,
    clip_p95: bool = True, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Equal-width counts between the group's smallest and largest value, last bin closed.

    A constant column is spread over [value - 0.5, value + 0.5] as plotting tools do.
    Empty bins are not listed.
    """
    groups = cols(groups)
    if clip_p95:
        table = clip_to_p95(df, groups, value, rows_per_range)
    else:
        table = value_table(df, groups, value).withColumn("clipped", F.col("value"))
    table = table.filter(F.col("clipped").isNotNull())
    ends = stage(table.groupBy(*groups).agg(F.min("clipped").alias("lo"), F.max("clipped").alias("hi")))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        *groups,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    joined = join_groups(table, ends, groups)
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    place = F.floor((F.col("clipped") - F.col("lo")) / width).cast("bigint")
    return (
        joined.withColumn("bin", F.least(place, F.lit(bins - 1).cast("bigint")))
        .groupBy(*groups, "bin")
        .agg(F.sum("n").alias("n"))
    )


def skewness(value: Column | str) -> Column:
    """Aggregate: bias-corrected sample skewness; null below three values or if constant."""
    c = F.col(value) if isinstance(value, str) else value
    c = null_if_nan(c.cast("double"))
    n = F.count(c)
    g1 = F.skewness(c)
    correction = F.sqrt(n.cast("double") * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when((n > 2) & (F.max(c) > F.min(c)), g1 * correction)


def rank_sums(
    df: DataFrame, groups: str | list[str], score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Per group: n1, n0, U of the positive class from mid-ranks, and the tie term."""
    table = value_table(df, groups, score, positive)
    table = stage(table.filter(F.col("value").isNotNull()).withColumn("t", F.col("c1") + F.col("c0")))
    rows = running(table, groups, "value", sums=["t"], rows_per_range=rows_per_range)
    t = F.col("t").cast("double")
    mid_rank = F.col("before_t") + (t + 1) / 2
    sums = rows.groupBy(*cols(groups)).agg(
        F.sum("c1").alias("n1"),
        F.sum("c0").alias("n0"),
        F.sum(mid_rank * F.col("c1")).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1 = F.col("n1").cast("double")
    return sums.withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2)


def mann_whitney(
    df: DataFrame, groups: str | list[str], score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Two-sided Mann-Whitney U, normal approximation, tie-corrected, continuity 0.5."""
    sums = rank_sums(df, groups, score, positive, rows_per_range)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    spread = n1 * n0 / 12 * ((n + 1) - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)))
    larger = F.greatest(F.col("u1"), n1 * n0 - F.col("u1"))
    z = (larger - n1 * n0 / 2 - 0.5) / F.nullif(F.sqrt(spread), F.lit(0.0))
    scored = sums.withColumn("z", z)
    # For z < 0 (only by the continuity correction) the two-sided p is above 1: cap it.
    # Without one of the classes there is no z and no p.
    p = F.when(F.col("z") < 0, F.lit(1.0)).when(
        F.col("z").isNotNull(), F.least(F.lit(1.0), erfc(F.col("z") / F.sqrt(F.lit(2.0)))))
    return (
        scored.withColumn("p", p)
        .withColumn("label", p_label("p"))
        .select(*cols(groups), "n1", "n0", "u1", "z", "p", "label")
    )


def roc_auc(
    df: DataFrame, groups: str | list[str], score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Area under the ROC curve, ties count half; null if a class is missing."""
    sums = rank_sums(df, groups, score, positive, rows_per_range)
    pairs = F.nullif(F.col("n1").cast("double") * F.col("n0"), F.lit(0.0))
    return sums.select(*cols(groups), (F.col("u1") / pairs).alias("auc"))


def roc_curve(
    df: DataFrame, groups: str | list[str], score: str, positive: Column, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Curve points by falling threshold; points inside a straight run are left out.

    The starting corner (0, 0) has an infinite threshold, given as null.
    """
    groups = cols(groups)
    table = value_table(df, groups, score, positive).filter(F.col("value").isNotNull())
    table = stage(table.filter(F.col("c1") + F.col("c0") > 0))
    rows = running(table, groups, "value", sums=["c1", "c0"], previous=["c1", "c0"], rows_per_range=rows_per_range)
    above1 = F.col("total_c1") - F.col("before_c1") - F.col("c1")
    above0 = F.col("total_c0") - F.col("before_c0") - F.col("c0")
    is_first = (above1 + above0) == 0
    is_last = F.col("prev_c1").isNull()
    bends = (F.col("prev_c1") != F.col("c1")) | (F.col("prev_c0") != F.col("c0"))
    points = rows.filter(is_first | is_last | bends).select(
        *groups,
        F.col("value").alias("threshold"),
        ((F.col("total_c0") - F.col("before_c0")) / F.nullif("total_c0", F.lit(0))).alias("fpr"),
        ((F.col("total_c1") - F.col("before_c1")) / F.nullif("total_c1", F.lit(0))).alias("tpr"),
    )
    corner = table.groupBy(*groups).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(corner)
