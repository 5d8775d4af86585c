"""Restartable ingest: records append as they arrive, each id once."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType,
    key: str = "id",
    fmt: str = "parquet",
    files_per_batch: int = 1000,
    **options: str,
) -> StreamingQuery:
    """Append new files of `source` to the parquet folder `target`, dropping repeated ids.
    Every record with a blank or null id is kept.

    Runs through what is there, then stops; the next start goes on after it. The id
    state has no watermark on purpose: with one, late records would be lost. Point
    `spark.sql.streaming.stateStore.providerClass` at the RocksDB provider for large id
    sets, it keeps state off the heap.
    """
    arriving = (
        spark.readStream.format(fmt).schema(schema).options(**options)
        .option("maxFilesPerTrigger", files_per_batch).load(source)
    )
    blank = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    fresh = arriving.filter(~blank).dropDuplicates([key]).unionByName(arriving.filter(blank))
    return (
        fresh.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

