"""Attempt-log rollups per event-time window on a stream (T2), with late
events bounded by a watermark. The batch twin is
:func:`ledgerframe.operators.attempts.windowed_rollup`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.functions.columns import lookup
from ledgerframe.plans.fixture_views import EVENT_OUTCOME


def events_as_attempts(events: DataFrame) -> DataFrame:
    """Each event as one attempt: outcome from event_type, duration = value x 100,
    ts as TIMESTAMP (a streaming watermark needs TIMESTAMP, not TIMESTAMP_NTZ)."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id",
        lookup(EVENT_OUTCOME, F.col("event_type")).alias("outcome"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"))


def window_rollup(attempts: DataFrame, duration: str = "1 hour", slide: str | None = None,
                  watermark: str | None = "10 minutes") -> DataFrame:
    """count / successes / mean duration per event-time window; with a
    watermark, a window is emitted once the watermark passes its end and
    events later than that are dropped."""
    a = attempts.withWatermark("ts", watermark) if watermark else attempts
    w = F.window("ts", duration) if slide is None else F.window("ts", duration, slide)
    return (a.groupBy(w.alias("w")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "success").alias("successes"),
        F.sum("duration_ms").alias("total_duration_ms"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "attempts", "successes", "total_duration_ms"))


def session_rollup(attempts: DataFrame, gap: str = "30 minutes", watermark: str | None = "10 minutes") -> DataFrame:
    """Sessions per user (activity separated by more than ``gap``)."""
    a = attempts.withWatermark("ts", watermark) if watermark else attempts
    return (a.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "success").alias("successes"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                "attempts", "successes"))


def start_window_stream(spark: SparkSession, source_dir: str, checkpoint: str, query_name: str,
                        duration: str = "1 hour", watermark: str = "10 minutes", available_now: bool = True):
    """Run :func:`window_rollup` over a directory of event parquet files into
    an in-memory table ``query_name`` (append mode: final windows only)."""
    schema = spark.read.parquet(source_dir).schema
    events = spark.readStream.schema(schema).parquet(source_dir)
    out = window_rollup(events_as_attempts(events), duration, watermark=watermark)
    writer = (out.writeStream.outputMode("append").format("memory").queryName(query_name)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
