"""Time windows over event streams, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str = "12 hours", late: str = "1 hour", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Start of window, key, events and greatest value; on a stream, windows close `late` after the newest event."""
    timed = events.withColumn("_ts", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.max("value").alias("vmax"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "vmax")
