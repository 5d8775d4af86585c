"""Keyword lists to canonical categories, and rankings of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.functions import fixed_values as fv
from plaintscope.functions.text import strip
from plaintscope.operators.ordered import share_of_total, top_per_group
from plaintscope.session import cols, small_side


def split_keywords(c: Column | str, sep: str = ",") -> Column:
    """Trimmed, non-blank pieces of a separated list, in order, repeats kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, sep), strip), lambda k: k != "")


def canonical_keywords(df: DataFrame, mapping: DataFrame, groups: str | list[str], keyword: str = "keyword") -> DataFrame:
    """Add `category`: the mapped name, or the keyword itself when unmapped.

    `mapping` has the group columns, `keyword` and `category`.
    """
    groups = cols(groups)
    lookup = mapping.select(*groups, F.col("keyword").alias(keyword), F.col("category").alias("__category"))
    joined = df.join(small_side(lookup), [*groups, keyword], "left")
    return joined.withColumn("category", F.coalesce("__category", keyword)).drop("__category")


def category_counts(df: DataFrame, mapping: DataFrame, groups: str | list[str], keywords: Column) -> DataFrame:
    """Hits per category. Keywords are counted first, so the lookup joins one row per
    distinct keyword and a very common keyword costs one row."""
    groups = cols(groups)
    hits = df.select(*groups, F.explode(keywords).alias("keyword"))
    counted = hits.groupBy(*groups, "keyword").agg(F.count(F.lit(1)).alias("__n"))
    named = canonical_keywords(counted, mapping, groups)
    return named.groupBy(*groups, "category").agg(F.sum("__n").alias("n"))


def category_share(counts: DataFrame, groups: str | list[str]) -> DataFrame:
    return share_of_total(counts, groups, "n")


def top_categories(counts: DataFrame, groups: str | list[str], n: int = fv.TOP_CATEGORIES) -> DataFrame:
    """Most frequent categories; ties in name order."""
    return top_per_group(counts, groups, [F.col("n").desc(), F.col("category").asc()], n, ["category"])


def first_seen_categories(
    df: DataFrame, mapping: DataFrame, groups: str | list[str], keywords: Column, row: str, n: int = fv.TOP_CATEGORIES
) -> DataFrame:
    """Most frequent categories; ties in order of first appearance (`row`, list place)."""
    groups = cols(groups)
    hits = df.select(*groups, row, F.posexplode(keywords).alias("__at", "keyword"))
    counted = hits.groupBy(*groups, "keyword").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.struct(row, "__at")).alias("__first")
    )
    merged = canonical_keywords(counted, mapping, groups).groupBy(*groups, "category").agg(
        F.sum("__n").alias("n"), F.min("__first").alias("__first")
    )
    return top_per_group(merged, groups, [F.col("n").desc(), F.col("__first").asc()], n, ["category"]).drop("__first")


def merged_categories(mapping: DataFrame, groups: str | list[str]) -> DataFrame:
    """Categories that absorb other terms, with the sorted terms. Mapping-sized."""
    renamed = mapping.filter(F.col("keyword") != F.col("category"))
    return renamed.groupBy(*cols(groups), "category").agg(
        F.array_sort(F.collect_set("keyword")).alias("terms")
    )
