"""Event-time helpers, which the reference lacks but Spark offers at no cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str, lateness: str) -> DataFrame:
    """Counts by tumbling window; events later than ``lateness`` are left out of closed windows."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of events no more than ``gap`` apart."""
    s = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
