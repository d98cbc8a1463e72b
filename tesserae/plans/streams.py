"""Event-time windows, sessions, and the canonical producer run as a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.closure import shared_folder
from tesserae.plans.catalog import registered, table
from tesserae.streaming import canonical


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@registered("""
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("ts", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return canonical.windowed(events, "ts", "1 hour", None, "10 minutes", ["event_type"], "v").select(_text("start"), "event_type", "n", "total")


@registered("""
SELECT strftime(time_bucket(INTERVAL '15 minutes', ts) - INTERVAL 15 MINUTE * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events, (VALUES (0), (1), (2), (3)) AS o(k) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return canonical.windowed(events, "ts", "1 hour", "15 minutes", "10 minutes", [], "v").select(_text("start"), "n", "total")


@registered("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, k""".replace(" AS end,", ' AS "end",'))
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return canonical.sessions(table(spark, d, "events").select("ts", "user_id"), "ts", "30 minutes", "10 minutes", "user_id").select("user_id", _text("start"), _text("end"), "n")


@registered("SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def streamed_totals(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, drained once into two sibling sinks; the totals of one of them."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    source = canonical.folder_stream(spark, d, schema, "events.parquet")
    canonical.run_producer(source, [canonical.parquet_sink(f"{run}/a"), canonical.parquet_sink(f"{run}/b")], f"{run}/checkpoint")
    stored = spark.read.schema(schema).parquet(f"{run}/a")
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total"))
