"""The walk-forward schedule on a stream: sliding windows over event time, late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_moments(ticks: DataFrame, length: str = "50 days", step: str = "10 days", late: str = "1 day") -> DataFrame:
    """(start, end, series, n, mean, sd) of ticks (series, ts, v), static or streaming; on a stream in append mode a window
    comes out once the watermark has passed its end."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    out = ticks.groupBy(F.window("ts", length, step).alias("w"), "series").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n", "mean", "sd")
