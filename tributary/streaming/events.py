"""Flow edges and their counts from a stream of events, with the state of each user kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steps(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Of a stream of events (ts, user_id, event_type): window, event_type, n and users (about), closed when the watermark passes.
    Works on a batch table as well."""
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.window("ts", window).alias("window"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
