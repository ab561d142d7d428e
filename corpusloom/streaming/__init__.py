"""Structured Streaming mirrors of the audit log and its rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def audit_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """A stream over an append-only folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def sliding_rates(events: DataFrame, *, width: str = "5 minutes", step: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean_value): works on streams (late rows by watermark) and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def unseen_only(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
