"""Small row-wise rules: flags, bands, labels, ratios, safe parses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintscope.functions import fixed_values as fv
from plaintscope.functions.text import strip


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binarise(c: Column | str, positive: str) -> Column:
    """1 if the trimmed value is `positive`, else 0; null stays null."""
    return (strip(c) == positive).cast("int")


def band(share: Column | str, bounds: tuple[float, float] = fv.NULL_BANDS) -> Column:
    low, high = bounds
    return F.when(_c(share) > high, "red").when(_c(share) > low, "amber").otherwise("green")


def skew_flag(skew: Column | str, limit: float = fv.SKEW_LIMIT) -> Column:
    return F.abs(_c(skew)) > limit


def p_label(p: Column | str) -> Column:
    return F.when(_c(p) < 0.001, "p < 0.001").when(_c(p).isNotNull(), F.format_string("p = %.3f", _c(p)))


def verdict(
    accuracy: Column | str, target: float = fv.ACCURACY_TARGET, labels: tuple[str, str] = ("met", "not met")
) -> Column:
    return F.when(_c(accuracy) >= target, labels[0]).otherwise(labels[1])


def direction(difference: Column | str, labels: tuple[str, str] = ("positive", "negative")) -> Column:
    return F.when(_c(difference) > 0, labels[0]).when(_c(difference).isNotNull(), labels[1])


def clip_upper(c: Column | str, high: Column | float) -> Column:
    """Values above `high` become `high`; null stays null."""
    return F.when(_c(c) > high, high).otherwise(_c(c))


def pct(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def rate(condition: Column) -> Column:
    """Aggregate: share of rows, in percent, where the condition holds (null counts as no)."""
    return F.lit(100.0) * F.count_if(condition) / F.nullif(F.count(F.lit(1)), F.lit(0))


def round_n(c: Column | str, n: int = 6) -> Column:
    return F.bround(_c(c), n)


def left_n(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def slug(c: Column | str) -> Column:
    return F.translate(F.replace(F.lower(_c(c)), F.lit(" "), F.lit("_")), "üöı", "uoi")


def safe_int(c: Column | str, default: int = 0) -> Column:
    """Whole-number text, else the default."""
    text = strip(c)
    ok = text.rlike(r"^[+-]?[0-9]+$")
    return F.coalesce(F.when(ok, text).try_cast("int"), F.lit(default))


def safe_double(c: Column | str) -> Column:
    return F.when(strip(c) != "", strip(c)).try_cast("double")


def null_if_nan(c: Column | str) -> Column:
    """Spark keeps NaN apart from null; statistics here treat both as missing."""
    return F.when(~F.isnan(_c(c)), _c(c))


def resolution_status(badge: Column | str) -> Column:
    """Three states from the badge text; any other badge text counts as resolved."""
    badge = _c(badge)
    return (
        F.when(badge.isNull(), fv.UNKNOWN)
        .when(badge.contains(fv.UNRESOLVED), fv.UNRESOLVED)
        .otherwise(fv.RESOLVED)
    )


def absolute_url(href: Column | str, root: str) -> Column:
    return F.when(F.coalesce(_c(href), F.lit("")) != "", F.concat(F.lit(root), _c(href))).otherwise("")


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz & Stegun 7.1.26, error < 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    series = F.lit(0.0)
    # Fixed values of the published approximation, highest power first.
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + F.lit(a)) * t
    return series * F.exp(-x * x)
