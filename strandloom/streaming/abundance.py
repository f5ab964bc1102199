"""Abundance over time (an extension): counts and sums per window of event time, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, key: str = "event_type", at: str = "ts", value: str = "value", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, key, n, total); works on batches and on streams."""
    out = events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
