"""Session set-up and the physical helpers the operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

T = TypeVar("T")
R = TypeVar("R")

# Rows up to which a narrow lookup frame may be broadcast. Callers prove the bound with
# `small_side`; beyond it the join stays a shuffle join under AQE.
BROADCAST_ROWS = 200_000

# Rows of a fit that one task takes on, at least.
ROWS_A_TASK = 2_000


def build_session(app: str = "plaintscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    Cluster sizing (executors, memory, `spark.checkpoint.dir`) belongs to the
    deployment; only semantics and adaptive execution are fixed here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="plaintscope-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back.

    Used where a frame feeds several jobs (split points, then the answer), so the
    input is scanned once and a lost executor never recomputes it differently.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` written once as parquet below the shared checkpoint folder and read back.

    For wide rows such as token lists and sparse vectors, which take several times as much as a checkpoint.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and blocks of jobs that nobody refers to any more. It does when the
    driver's JVM collects its garbage, which would come too late in a loop of many jobs."""
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast if it has at most `max_rows` rows, else return it as is.

    The count stops at the bound. Pass staged or cheap frames: it is an action.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(source: DataFrame, key: str) -> DataFrame:
    """Rows of a source spread over the cluster when its files give fewer splits than cores.

    A few large row groups or multi-line CSV files would otherwise run expensive row work
    in a few tasks. With enough splits, as in any large table, nothing is shuffled. Call
    it on a plain scan.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    if source.rdd.getNumPartitions() >= cores:
        return source
    return source.repartition(cores, key)


def join_groups(
    left: DataFrame, right: DataFrame, groups: str | list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a per-group table to rows of the groups; null is a group, as in groupBy.

    The table is broadcast if it proves small enough (see `small_side`), so a hot group's
    rows stay where they are.
    """
    groups = cols(groups)
    theirs = [F.col(g).alias(f"__their_{g}") for g in groups]
    table = right.select(*theirs, *[c for c in right.columns if c not in groups])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__their_{g}")) for g in groups])
    joined = left.join(small_side(table, max_rows), same, how)
    return joined.drop(*[f"__their_{g}" for g in groups])


def group_key(groups: list[str]) -> Column:
    """The group columns as one never-null value that is equal when all of them are."""
    return F.struct(*groups) if groups else F.lit(0)


def in_parallel(work: Callable[[T], R], items: Iterable[T], parallelism: int = 4) -> list[R]:
    """Results of independent model fits in order, a few of them running at a time.

    A fit on one group is a chain of short jobs that leaves most of a cluster idle.
    """
    items = list(items)
    if len(items) <= 1 or parallelism <= 1:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about `rows` rows, dealt evenly over fewer tasks, no more than cores, where it is
    small: a fit passes over it many times. A table of many tasks for each core stays as it is."""
    tasks, cores = math.ceil(rows / ROWS_A_TASK) or 1, df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(tasks, cores)) if tasks <= 4 * cores else df


def cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
