"""Structured Streaming forms of the audits and profiles (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def sliding(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", key, "n")


def first_of_each(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
