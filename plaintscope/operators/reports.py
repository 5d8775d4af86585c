"""Comparison reports assembled from the operators. All inputs here are already small:
one row per group, month, model or topic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.functions.scalars import clip_upper, left_n, verdict
from plaintscope.operators import distribution as D, profile as P

# What each hypothesis row states.
STATEMENTS = {
    "H1": "complaint topics differ between groups",
    "H2": "some terms go with unresolved complaints",
    "H3": "resolution can be predicted with the target accuracy",
    "H4": "complaint volume has a trend",
    "H5": "resolved complaints score higher",
}


def _joined(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """All lines in order as one text: first those of each group, then the groups' texts."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    per_group = rows.groupBy("group_key").agg(F.array_join(packed["line"], "\n").alias("lines"))
    texts = F.array_sort(F.collect_list(F.struct("group_key", "lines")))
    return per_group.agg(F.array_join(texts["lines"], "\n").alias("result"))


def topic_lines(counts: DataFrame) -> DataFrame:
    """H1: documents per topic. `counts` is (group_key, topic, n)."""
    line = F.format_string("%s | topic %d: %d", "group_key", F.col("topic") + 1, "n")
    return _joined(counts, ["group_key", "topic"], line)


def term_lines(features: DataFrame) -> DataFrame:
    """H2: heaviest terms per group and the class they point to."""
    side = F.when(F.col("signed") < 0, "unresolved").otherwise("resolved")
    line = F.format_string("%s | %s: %.4f (%s)", "group_key", "term", "importance", side)
    ordered = features.withColumn("place", -F.col("importance"))
    return _joined(ordered, ["group_key", "place", "term"], line)


def accuracy_lines(board: DataFrame) -> DataFrame:
    """H3: accuracy per group and model against the target."""
    line = F.format_string("%s | %s: %.4f → %s", "group_key", "model", "accuracy", verdict("accuracy"))
    return _joined(board, ["group_key", "model"], line)


def trend_lines(trend: DataFrame) -> DataFrame:
    """H4: slope of the monthly counts per group."""
    line = F.format_string("%s: slope=%.3f over %d months", "group_key", "slope", "months")
    return _joined(trend, ["group_key"], line)


def gap_lines(gap: DataFrame) -> DataFrame:
    """H5: mean score of both classes and their difference."""
    line = F.format_string(
        "%s: resolved=%.2f | other=%.2f | difference=%.3f (%s)", "group_key", "mean1", "mean0", "diff", "direction"
    )
    return _joined(gap.filter(F.col("diff").isNotNull()), ["group_key"], line)


def hypothesis_report(length: int | None = None, **texts: DataFrame) -> DataFrame:
    """(id, statement, result) from one-row text frames keyed by hypothesis id; with `length`,
    so many characters of each result."""
    rows = [
        text.select(
            F.lit(h).alias("id"), F.lit(STATEMENTS[h]).alias("statement"),
            (F.col("result") if length is None else left_n(F.col("result"), length)).alias("result"),
        )
        for h, text in sorted(texts.items())
    ]
    return reduce(DataFrame.unionByName, rows)


def dashboard(df: DataFrame, group: str, resolved: Column, score: str, month: str, views: str,
              bounded_score: bool = True) -> DataFrame:
    """Long table (panel, group_key, month, value): counts, resolved rate, mean and median
    score, median views, monthly counts."""
    per_group = P.kpi_table(df.withColumn("__w", F.lit(0)), group, resolved, score, "__w", views, bounded_score)
    per_group = per_group.join(D.median_by(df, group, views), group)
    panels = per_group.select(
        F.col(group).alias("group_key"), F.col("n").cast("double").alias("A_count"), F.col("resolved_pct").alias("B_resolved"),
        F.col("mean_score").alias("C_mean_score"), F.col("med_score").alias("C_median_score"), F.col("median").alias("E_median_views"),
    ).unpivot(["group_key"], ["A_count", "B_resolved", "C_mean_score", "C_median_score", "E_median_views"], "panel", "value")
    months = P.monthly_counts(df, group, month).select(
        F.lit("D_monthly").alias("panel"), F.col(group).alias("group_key"), F.col(month).alias("month"),
        F.col("n").cast("double").alias("value"),
    )
    flat = panels.select("panel", "group_key", F.lit(None).cast("string").alias("month"), "value")
    return flat.unionByName(months)


def chart_tables(df: DataFrame, group: str, resolved: Column, score: str, month: str, reply: str, views: str,
                 columns: list[str], categories: DataFrame | None = None) -> dict[str, DataFrame]:
    """The table behind each standard chart, by chart name. `categories` is (group, category, n)
    of the category chart, which is left out without it. Null view counts take no part in the boxes."""
    charts = {
        "counts": P.value_counts(df, group),
        "resolved_rate": P.rate_by(df, group, resolved),
        "score_distribution": P.score_distribution(df, group, score),
        "score_by_resolution": D.mann_whitney(df, group, score, resolved),
        "score_boxes": D.box_stats(df.withColumn("class", resolved.cast("int")), [group, "class"], score),
        "monthly_trend": P.trend_points(P.monthly_counts(df, group, month), group, month),
        "reply_rate": P.rate_by(df, group, F.col(reply).isNotNull()),
        "view_boxes": D.box_stats(df.withColumn("__v", clip_upper(views, F.lit(1000))), group, "__v"),
        "null_panel": P.null_panel(df, group, columns),
    }
    return charts if categories is None else charts | {"categories": categories}


def chart_rows(charts: dict[str, DataFrame], group: str, items: dict[str, str]) -> DataFrame:
    """All charts in one long table (chart, group_key, item, measure, value).

    `items` names for a chart the column that tells its points apart (a month, a score, a
    category); a chart without one has one point a group, with a null item. Every other numeric
    column is a measure; texts such as bands and labels follow from these.
    """
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    rows = []
    for name, table in charts.items():
        item = items.get(name)
        measures = [c for c, kind in table.dtypes if c not in (group, item) and kind.split("(")[0] in numeric]
        wide = table.select(F.col(group).cast("string").alias("group_key"), (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias("item"),
                            *[F.col(m).cast("double").alias(m) for m in measures])
        rows.append(wide.unpivot(["group_key", "item"], measures, "measure", "value").withColumn("chart", F.lit(name)))
    return reduce(DataFrame.unionByName, rows).select("chart", "group_key", "item", "measure", "value")
