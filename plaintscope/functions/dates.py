"""Dates: Turkish date texts, coercing parses, month keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintscope.functions.fixed_values import TURKISH_MONTHS

_DAY_MONTH = r"([0-9]{1,2})[\s\p{Z}]+([\p{L}\p{N}_]+)"
_DAY_MONTH_YEAR = _DAY_MONTH + r"[\s\p{Z}]+([0-9]{4})"


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month != "0", F.try_to_date(text, "yyyy-MM-dd"))


def parse_tr_date(text: Column | str, today: Column) -> Column:
    """`15 Kasım 2025 09:30` or, without a year, the latest such day not after `today`.

    A text whose year form is no valid date is tried again without the year.
    """
    text = F.col(text) if isinstance(text, str) else text
    months = F.array(*[F.lit(m) for m in TURKISH_MONTHS])

    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    def month(pattern: str) -> Column:
        return F.array_position(months, group(pattern, 2)).cast("string")

    full = _date(group(_DAY_MONTH_YEAR, 3), month(_DAY_MONTH_YEAR), group(_DAY_MONTH_YEAR, 1))
    this_year = _date(F.year(today).cast("string"), month(_DAY_MONTH), group(_DAY_MONTH, 1))
    last_year = _date((F.year(today) - 1).cast("string"), month(_DAY_MONTH), group(_DAY_MONTH, 1))
    return F.coalesce(full, F.when(this_year > today, last_year).otherwise(this_year))


def to_date_coerce(c: Column | str) -> Column:
    """ISO text to date, anything else to null."""
    return F.try_to_date(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def month_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")
