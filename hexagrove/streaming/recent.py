"""Incremental forms over event streams: windowed counts with a watermark, running step times.

The reference has no streams; these serve pipelines that append to the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling-window count and mean by kind; works on a stream and on a table."""
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    out = seen.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    out = seen.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")
