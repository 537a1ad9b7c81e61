"""Windowed counts that give the same result over a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, keys, n) by tumbling or sliding windows; on a stream, rows over ``late`` behind the newest are dropped."""
    if late is not None and events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(start, end, keys, n): runs of events less than ``gap`` apart; the end is the last event plus the gap."""
    if late is not None and events.isStreaming:
        events = events.withWatermark(time, late)
    s = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
