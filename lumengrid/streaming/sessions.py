"""Session and tumbling windows; on a stream a watermark bounds the state and closes windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    if not events.isStreaming:
        return events
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    return events.withWatermark("ts", late)


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """``events(ts, user_id)`` to ``(user_id, start, end, n)``; a pause of ``gap`` or more starts a session."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """``events(ts, event_type, value)`` to ``(event_type, start, n, total)`` per window."""
    out = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")
