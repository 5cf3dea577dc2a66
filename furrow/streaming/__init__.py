"""Operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def composite_stream(obs: DataFrame, days: int = 30, late: str = "1 day", value: str = "value", pixel: str = "pixel_id", ts: str = "ts") -> DataFrame:
    """R20 on a stream: (pixel, start, end, mean, n) for each pixel and window of days; a window is final once the watermark has passed it."""
    timed = obs.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(pixel, F.window(ts, f"{days} days").alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(pixel, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")
