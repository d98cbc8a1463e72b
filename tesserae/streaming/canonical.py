"""The canonical producer: a bounded, ordered, resumable stream into sibling sinks, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Sink = Callable[[DataFrame, int], None]


def run_producer(source: DataFrame, sinks: Sequence[Sink], checkpoint: str) -> None:
    """Drains a streaming source once; every batch goes to all sinks, and a restart resumes after the last whole batch.

    Sinks must be idempotent per batch number, since a batch that failed halfway comes again.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    query = source.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_sink(path: str) -> Sink:
    """Each batch into a directory of its own, overwritten when it comes again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def folder_stream(spark: SparkSession, folder: str, schema: T.StructType, name_filter: str | None = None, files_per_batch: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def windowed(events: DataFrame, time: str, length: str, slide: str | None, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window and keys; the same plan for a table and, with the watermark, for a stream."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
