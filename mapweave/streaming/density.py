"""Pixel counts of records as they arrive, by event time. The batch build needs none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, cell: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and cell; records later than ``late`` are dropped, and windows close behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *cell).agg(F.count("*").alias("total")).select(F.col("window.start").alias("start"), *cell, "total")
