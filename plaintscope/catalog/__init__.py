"""Registered queries: each a function of the tables, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintscope.session import checkpoint_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """`t.orders` is the orders table of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, *columns: str) -> DataFrame:
        """The named document columns, spread over all cores for work on the texts."""
        return spread(self.documents.select("doc_id", "text", *columns), "doc_id")

    def labelled(self) -> DataFrame:
        """Documents with their labels where there are any."""
        return self.documents.join(self.labels, "doc_id", "left")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def scratch(t: Tables, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def r6(c: Column | str) -> Column:
    """Six digits, half-even, as the SQL side rounds."""
    return F.bround(c, 6)


def load_all() -> None:
    from plaintscope.catalog import (  # noqa: F401
        features, html, learning, ordered, profile, reports, text, topics,
    )
