"""Sessions and popularity over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, user: str, time: str, idle_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n_events) of the sessions of a stream; a gap of exactly idle_seconds doesn't end one."""
    window = F.session_window(F.col(time), f"{idle_seconds} seconds")
    out = events.withWatermark(time, late).groupBy(F.col(user), window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(time).alias("end"))
    return out.select(user, F.col("w.start").alias("start"), "end", "n_events")


def stream_popularity(events: DataFrame, item: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(item, start, n_events): items' events by window."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(item)).agg(F.count(F.lit(1)).alias("n_events")).select(item, F.col("w.start").alias("start"), "n_events")
