"""Streaming forms of the stateful rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, client: str, time: str, limit: int, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """Requests of each client in fixed windows, closed by the watermark, and whether they went over the limit."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds").alias("w"), F.col(client)).agg(F.count("*").alias("request_count"))
    return counted.select(client, F.unix_seconds("w.start").alias("window_start"), "request_count", (F.col("request_count") > limit).alias("limited"))
