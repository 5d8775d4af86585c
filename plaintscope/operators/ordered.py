"""Order-dependent rules that never put one whole group into one task.

A plain window partitioned by group would sort a hot group in a single task. Here
rows are cut into value ranges first: windows run inside (group, range), and a small
per-range table carries totals and edge rows from one range to the next.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from plaintscope.session import cols, group_key, join_groups, stage

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 10_000
_RANGE = "__range"
_ORDER = "__order"


def add_ranges(df: DataFrame, order: Column, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add a range number that grows with `order`, about `rows_per_range` rows each.

    `df` must be staged: it is counted, and read once for split points.
    """
    df = df.withColumn(_ORDER, order.cast("double"))
    wanted = min(MAX_RANGES, math.ceil(df.count() / rows_per_range))
    if wanted <= 1:
        return df.withColumn(_RANGE, F.lit(0.0))
    splitter = QuantileDiscretizer(
        numBuckets=wanted, relativeError=0.1 / wanted, handleInvalid="keep",
        inputCol=_ORDER, outputCol=_RANGE,
    )
    # Nulls sort first, so they belong to the first range.
    first = F.coalesce(F.col(_ORDER), F.lit(float("-inf")))
    return splitter.fit(df).transform(df.withColumn(_ORDER, first))


def running(
    df: DataFrame,
    groups: str | list[str],
    order: str,
    sums: list[str] = (),
    previous: list[str] = (),
    tie: list[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exclusive running sums, group totals and previous-row values in group order.

    For each name in `sums` adds ``before_<name>`` (sum over earlier rows of the group)
    and ``total_<name>``; for each name in `previous` adds ``prev_<name>``. Rows are
    ordered by the numeric or time column `order`, then `tie`. `df` must be staged, and
    `order` nearly unique in a group: rows of equal `order` always share a task. A value
    table, one row per distinct value, is.
    """
    groups = cols(groups)
    key = F.col(order)
    if dict(df.dtypes)[order] in ("timestamp_ntz", "date"):
        key = key.cast("timestamp")
    ranged = add_ranges(df.withColumn("__g", group_key(groups)), key, rows_per_range)
    sort = [F.col(order).asc_nulls_first(), *[F.col(t) for t in tie]]

    totals = [F.sum(c).alias(f"__sum_{c}") for c in sums]
    edge = F.max_by(F.struct(*previous), F.struct(order, *tie)).alias("__last") if previous else None
    per_range = ranged.groupBy("__g", _RANGE).agg(
        *totals, *([edge] if previous else []), F.lit(1).alias("__one")
    )
    by_range = Window.partitionBy("__g").orderBy(_RANGE)
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__g")
    carried = per_range.select(
        "__g",
        _RANGE,
        *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in sums],
        *[F.sum(f"__sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
        *([F.lag("__last").over(by_range).alias("__carried")] if previous else []),
    )

    inside = Window.partitionBy("__g", _RANGE).orderBy(*sort)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__in_{c}") for c in sums],
        *([F.lag(F.struct(*previous)).over(inside).alias("__near")] if previous else []),
    )
    joined = local.join(carried, ["__g", _RANGE])
    keep = df.columns
    return joined.select(
        *keep,
        *[(F.col(f"__off_{c}") + F.col(f"__in_{c}")).alias(f"before_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
        *[F.coalesce("__near", "__carried")[c].alias(f"prev_{c}") for c in previous],
    )


def take_while(
    df: DataFrame, groups: str | list[str], order: list[Column], stop: Column
) -> DataFrame:
    """Rows before the first row (in `order`) for which `stop` holds, per group.

    The cut position is an aggregate, so no window over the group is needed; later rows
    are dropped even if they would pass again. `order` columns sort ascending.
    """
    groups = cols(groups)
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = df.withColumn("__place", place)
    cut = stage(keyed.filter(stop).groupBy(*groups).agg(F.min("__place").alias("__cut")))
    joined = join_groups(keyed, cut, groups, "left")
    return joined.filter(F.col("__cut").isNull() | (F.col("__place") < F.col("__cut"))).select(*df.columns)


def first_of_page(df: DataFrame, groups: str | list[str], page: str, pos: str, item: str) -> DataFrame:
    """One row per page: the id of its first item."""
    return df.groupBy(*cols(groups), page).agg(F.min_by(item, pos).alias("first_id"))


def drop_repeats(
    pages: DataFrame,
    groups: str | list[str],
    page: str,
    first_id: str = "first_id",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Pages before the first one whose first id equals that of the page before it."""
    groups = cols(groups)
    linked = running(stage(pages), groups, page, previous=[first_id], rows_per_range=rows_per_range)
    repeat = F.coalesce(F.col(first_id) == F.col(f"prev_{first_id}"), F.lit(False))
    kept = take_while(linked, groups, [F.col(page)], repeat)
    return kept.select(*pages.columns)


def date_range(df: DataFrame, c: str, low: Column, high: Column, keep_null: bool = True) -> DataFrame:
    inside = F.col(c).between(low, high)
    return df.filter(F.col(c).isNull() | inside if keep_null else inside)


def top_per_group(
    df: DataFrame, groups: str | list[str], order: list[Column], n: int, spread: list[str] = ()
) -> DataFrame:
    """The first `n` rows of each group in `order`, which must be total; adds `rank`.

    Up to 1,000 Spark itself keeps only n rows per map task before the shuffle
    (window group limit). For larger n a first round ranks inside hashed slices of the
    group, by the columns in `spread` or all of them, so one task never sorts a whole hot group.
    """
    groups = cols(groups)
    if n > 1000:
        sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(256)))
        w = Window.partitionBy(*groups, "__slice").orderBy(*order)
        df = sliced.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("__slice", "rank")
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def limit_per_group(df: DataFrame, groups: str | list[str], order: list[Column], n: int, spread: list[str] = ()) -> DataFrame:
    return top_per_group(df, groups, order, n, spread).drop("rank")


def sequence_index(df: DataFrame, groups: str | list[str], order: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """0-based position of each row inside its group; `order` must be unique in the group."""
    counted = stage(df.withColumn("__unit", F.lit(1)))
    ranked = running(counted, groups, order, sums=["__unit"], rows_per_range=rows_per_range)
    return ranked.withColumn("seq", F.col("before___unit")).select(*df.columns, "seq")


def last_point(df: DataFrame, groups: str | list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*cols(groups)).agg(
        F.max(order).alias(order), F.max_by(value, order).alias(value)
    )


def page_coverage(cards: DataFrame, page: str | list[str], pos: str, date: str) -> DataFrame:
    """First and last readable date and card count of each page, in card order."""
    dated = F.when(F.col(date).isNotNull(), F.col(pos))
    return cards.groupBy(*cols(page)).agg(
        F.min_by(date, dated).alias("first_date"),
        F.max_by(date, dated).alias("last_date"),
        F.count(F.lit(1)).alias("cards"),
    )


def share_of_total(df: DataFrame, groups: str | list[str], n: str) -> DataFrame:
    """Percent of the group total. Totals are aggregated and joined, not windowed."""
    groups = cols(groups)
    totals = stage(df.groupBy(*groups).agg(F.sum(n).alias("__total")))
    joined = join_groups(df, totals, groups)
    return joined.withColumn("share", F.lit(100.0) * F.col(n) / F.col("__total")).drop("__total")
