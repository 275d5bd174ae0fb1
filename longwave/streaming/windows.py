"""Slicing of unbounded event streams: an extension, with the batch operators' meaning where they have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, window: str, hop: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per window and file statistics of events (ts, file, value), late data up to a watermark."""
    grid = F.window("ts", window, hop) if hop else F.window("ts", window)
    grouped = events.withWatermark("ts", late).groupBy(grid.alias("w"), "file")
    stats = grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "file", "n", "mean", "stdev", "min", "max")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a file that are closer than a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "file")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "file", "n", "mean")
