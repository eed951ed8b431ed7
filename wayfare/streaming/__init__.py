"""Streams: the trajectory work is batch; gap segmentation also runs on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user, start, end, n): events of a user closer than the gap, closed by the watermark."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
