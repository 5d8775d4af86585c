"""Whitening of embedding vectors: blockwise QR of centred rows, then a bidiagonal qd solver.

Entries become integers on a fixed grid, so that counts, sums and deviations are exact. The fit
list is each distinct vector once. Every task reduces its centred rows block by block to one
triangle; the triangles are stacked and reduced in a tree. The covariance is never formed: its
eigenvalues are the squared singular values of the last triangle over n (see `bidiagonal`), and
its eigenvectors the right singular vectors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plaintscope.llm.bidiagonal import right_singular
from plaintscope.llm.textarrays import with_result
from plaintscope.session import checkpoint_dir

GRID = 64              # steps a unit of an entry
SHIFT = 1_000_000      # added to each entry's step number
COMPONENTS = 16
BLOCK_BYTES = 4 << 20  # of doubles that one QR takes at once
LONG = 2.0**62


@dataclass
class Whitening:
    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray  # dimensions x components, already over sqrt(eigenvalue)
    explained: list[float]
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums, self.mean)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where one does not fit in a long."""
        about = np.abs(self.centred(x)).max(axis=1, initial=0.0) * self.n
        fits = about * about * max(x.shape[1], 1) < LONG
        away = x[fits] * self.n - np.array(self.sums, np.int64) if fits.any() and self.n * np.abs(x[fits]).max() < LONG else None
        if away is not None and fits.all():
            return (away * away).sum(axis=1).tolist()
        found = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in found]


def centred(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> np.ndarray:
    """x - S/n to the last bit where n x fits in a long, else by doubles."""
    if n * (np.abs(x).max(initial=0) + 1) < LONG:
        return (x * n - np.array(sums, np.int64)) / n
    return x - mean


def grid(vector: str) -> Column:
    """The vector as whole numbers; null where it is null or holds a null or non-finite entry."""
    whole = F.transform(F.col(vector), lambda c: F.floor(F.lit(GRID) * c.cast("double")) + F.lit(SHIFT))
    usable = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(usable, whole)


def rows_of(column: pa.Array, dimensions: int) -> np.ndarray:
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square R of a QR factorisation, with rows of zeros where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate((r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))))


def depth(tasks: int) -> int:
    """Levels of a tree in which no step adds more than about 16 parts."""
    return max(2, math.ceil(math.log(max(tasks, 2), 16)))


def fit(vectors: DataFrame, vector: str = "x", components: int = COMPONENTS) -> Whitening | None:
    """Whitening directions of a table of distinct whole-number vectors of one length; None if
    there is no vector or no dimension. Directions without variance (a share of the largest
    eigenvalue within rounding) cannot be scaled to one and are left out."""
    first = vectors.agg(F.max(F.size(vector)), F.count("*")).first()
    dimensions, n = first[0] or 0, first[1]
    if not n or not dimensions:
        return None
    rows = vectors.select(F.col(vector).alias("x"))
    block = max(dimensions, BLOCK_BYTES // (8 * dimensions))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions, np.int64)
        for batch in batches:
            total += rows_of(batch.column(0), dimensions).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dimension": np.arange(dimensions), "total": total})

    totals = rows.mapInArrow(summed, "dimension bigint, total bigint").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = [int(r.total) for r in totals.orderBy("dimension").collect()]
    mean = np.array([s / n for s in sums])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros((dimensions, dimensions))
        for batch in batches:
            for at in range(0, len(batch), block):
                part = centred(rows_of(batch.column(0).slice(at, block), dimensions), n, sums, mean)
                done = triangle(np.concatenate((done, part)))
        yield pa.RecordBatch.from_pydict({"r": [done.tobytes()]})

    parts = rows.mapInArrow(reduced, "r binary").rdd.map(lambda row: np.frombuffer(row.r).reshape(dimensions, dimensions))
    last = parts.treeReduce(lambda a, b: triangle(np.concatenate((a, b))), depth(parts.getNumPartitions()))
    values, directions = right_singular(last, min(components, dimensions))
    values = values / n
    useful = int((values[:components] > values[0] * dimensions * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    scaled = directions[:, :useful] / np.sqrt(values[:useful])
    explained = (values[:useful] / max((last * last).sum() / n, 1e-300)).tolist()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = (0, np.zeros(useful), np.zeros((useful, useful)))
        for batch in batches:
            for at in range(0, len(batch), block):
                w = centred(rows_of(batch.column(0).slice(at, block), dimensions), n, sums, mean) @ scaled
                middle = w.mean(axis=0)
                done = joined(done, (len(w), middle, (w - middle).T @ (w - middle)))
        yield pa.RecordBatch.from_pydict({"count": [done[0]], "mean": [done[1].tobytes()], "products": [done[2].tobytes()]})

    error = 0.0
    if useful:
        parts = rows.mapInArrow(moments, "count bigint, mean binary, products binary").rdd.map(
            lambda row: (row["count"], np.frombuffer(row["mean"]), np.frombuffer(row["products"]).reshape(useful, useful)))
        _, _, products = parts.treeReduce(joined, depth(parts.getNumPartitions()))
        error = float(np.abs(products / n - np.eye(useful)).max())
    return Whitening(n, sums, mean, scaled, explained, error)


def joined(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows as those of both."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def distinct_vectors(spark: SparkSession, whole: DataFrame, vector: str) -> DataFrame:
    """Each vector once, of the commonest length (the longer one of equals), written to the shared folder."""
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    whole.select(F.col(vector).alias("x")).filter("x IS NOT NULL").distinct().write.parquet(path)
    once = spark.read.parquet(path)
    lengths = once.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return once.filter(F.size("x") == (lengths.length if lengths else 0))


def with_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, out: str = "whitening") -> DataFrame:
    """The usable rows of `df` plus struct(n, deviation, whitened, explained, identity_error).

    `whitened` and `explained` are lists with one entry a component, by falling eigenvalue.
    Rows whose vector is null or holds null or non-finite entries are left out, and so are those
    whose vector has another length than most distinct vectors: they lie in another space.
    Repeated vectors count once in the fit and each get their row; equal eigenvalues have some
    orthogonal directions of their space. Directions without variance are left out, so the lists
    may be shorter than `components`, or empty where all vectors are equal. An empty table, or
    one of empty vectors, gives empty tables. `deviation` is null where it exceeds a long. Other
    columns stay; one called as `out` (in any case) is replaced. Vectors of any length work while
    a square of their length fits in a task; ids take no part.
    """
    spark, whole = df.sparkSession, with_result(df, out, grid(vector))
    once = distinct_vectors(spark, whole, out)
    model = fit(once, "x", components)
    if model is None:
        kind = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
        return whole.filter(F.lit(False)).withColumn(out, F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>"))
    dimensions, shared = len(model.sums), spark.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = shared.value
        for batch in batches:
            x = rows_of(batch, dimensions)
            w = ready.centred(x) @ ready.directions
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.StructArray.from_arrays(
                [pa.array(ready.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["deviation", "whitened"])

    found = F.arrow_udf(projected, "struct<deviation:bigint, whitened:array<double>>").asNondeterministic()
    usable = whole.filter(F.col(out).isNotNull() & (F.size(out) == dimensions)).withColumn(out, found(F.col(out)))
    return usable.withColumn(out, F.struct(
        F.lit(model.n).alias("n"), F.col(out)["deviation"].alias("deviation"), F.col(out)["whitened"].alias("whitened"),
        F.lit(model.explained).cast("array<double>").alias("explained"), F.lit(model.identity_error).alias("identity_error")))


def components(whitened: DataFrame, key: str = "vec_id", column: str = "whitening") -> DataFrame:
    """One row for each row and component of `with_whitening`."""
    m = F.col(column)
    rows = whitened.select(key, m.alias("m"), F.posexplode(m["whitened"]).alias("k", "whitened"))
    return rows.select(
        key, (F.col("k") + 1).alias("component"), F.col("m.n").alias("n"), F.col("m.deviation").alias("deviation"), "whitened",
        F.get(F.col("m.explained"), F.col("k")).alias("explained"), F.col("m.identity_error").alias("identity_error"))
