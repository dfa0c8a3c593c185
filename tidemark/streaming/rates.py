"""Structured Streaming: change and rate of counters over tumbling windows, beyond the batch engine.

Late samples count while the watermark allows. Each window is an aggregate of its own: resets between
windows do not show, those within one do not either; use it for live counters, and the engine for history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_rates(samples: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(lkey, ts_ms, value) of a streaming frame (lkey, at timestamp, value): increase a second from the
    first to the last sample of each window, at the window's end. Windows with one time give no row."""
    seen = samples.withWatermark("at", watermark).groupBy("lkey", F.window("at", window).alias("w"))
    d = seen.agg(F.min_by("value", "at").alias("v0"), F.max_by("value", "at").alias("v1"), F.min("at").alias("a"), F.max("at").alias("b"))
    span = F.unix_millis("b") - F.unix_millis("a")
    delta = F.when(F.col("v1") < F.col("v0"), F.col("v1")).otherwise(F.col("v1") - F.col("v0"))
    return d.where(span > 0).select("lkey", F.unix_millis(F.col("w.end")).alias("ts_ms"), (delta / (span / 1000.0)).alias("value"))
