"""Complaint sources: CSV files, several tagged sources, newest stage, fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from plaintscope.functions import fixed_values as fv
from plaintscope.functions.dates import month_key, to_date_coerce
from plaintscope.functions.scalars import null_if_nan
from plaintscope.functions.text import char_count, word_count

_TYPES = {"satisfaction": T.DoubleType(), "view_count": T.IntegerType(), "upvote_count": T.IntegerType()}

COMPLAINT_SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in fv.COMPLAINT_COLUMNS])

METRICS_SCHEMA = "group_key string, model string, accuracy double, precision double, recall double, f1 double, auc double, cv_mean double, cv_std double"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Header CSV whose quoted fields may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )


def read_complaints(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw complaints, typed: date parsed, blank text fields and NaN become null."""
    raw = read_csv(spark, path, COMPLAINT_SCHEMA)
    text = [f.name for f in COMPLAINT_SCHEMA if f.dataType == T.StringType() and f.name not in ("id", "date")]
    return raw.select(*[
        F.nullif(F.col(c), F.lit("")).alias(c) if c in text
        else to_date_coerce(c).alias(c) if c == "date"
        else null_if_nan(c).alias(c) if c == "satisfaction"
        else F.col(c)
        for c in fv.COMPLAINT_COLUMNS
    ])


def with_derived(df: DataFrame, text: str = "full_text", date: str = "date") -> DataFrame:
    return df.withColumns({"month": month_key(date), "n_words": word_count(text), "n_chars": char_count(text)})


def tag_and_union(frames: dict[str, DataFrame], names: dict[str, str] | None = None) -> DataFrame:
    """Stack frames, each tagged with its key and display name; missing columns are null."""
    names = names or {}
    tagged = [
        df.withColumns({"group_key": F.lit(k), "group_name": F.lit(names.get(k, k))}) for k, df in frames.items()
    ]
    whole = tagged[0]
    for df in tagged[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole


def load_sources(spark: SparkSession, paths: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    return tag_and_union({k: read_complaints(spark, p) for k, p in paths.items()}, names)


def load_stage(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first parquet stage that exists, newest first. One that exists but cannot be read,
    such as the rest of a failed overwrite, is an error and not passed over."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of the stages exists: {paths}")


def conform(df: DataFrame, columns: list[str] = fv.COMPLAINT_COLUMNS, default: str = "") -> DataFrame:
    """Exactly these columns in this order; absent columns and nulls in text become `default`."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.lit(default).alias(c) if c not in kinds
        else F.coalesce(F.col(c), F.lit(default)).alias(c) if kinds[c] == "string"
        else F.col(c)
        for c in columns
    ])


def with_fallback(df: DataFrame, wanted: str, instead: str) -> DataFrame:
    return df if wanted in df.columns else df.withColumn(wanted, F.col(instead))


def display_name(df: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Add `name` from the lookup table, falling back to the key itself."""
    from plaintscope.session import small_side

    lookup = dim.select(key, F.col(name).alias("__name"))
    joined = df.join(small_side(lookup), key, "left")
    return joined.withColumn(name, F.coalesce("__name", F.col(key).cast("string"))).drop("__name")
