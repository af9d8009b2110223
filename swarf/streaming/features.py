"""Channel statistics over event-time windows of a reading stream.

The batch operators that only map rows or aggregate groups also accept streaming frames; this module adds
the event-time window and watermark around ``time_features``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.operators.features import time_features


def stream_time_features(readings: DataFrame, window: str = "1 hour", late: str = "10 minutes", flavor: str = "cut") -> DataFrame:
    """Statistics per (window, series, channel); rows later than ``late`` are left out.

    Moments are mergeable, so the state is a few numbers per open window and channel.
    """
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    stats = time_features(timed.withColumn("window", F.window("ts", window)), ["window", "series_id", "channel"], flavor)
    return stats.select(F.col("window.start").alias("window_start"), *[c for c in stats.columns if c != "window"])
