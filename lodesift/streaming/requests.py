"""The request window as a stream: counts by scope and fixed window, late requests within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(requests: DataFrame, by: str = "event_type", at: str = "ts", period: str = "1 hour", late: str = "10 minutes", limit: int = 100) -> DataFrame:
    """(by, window_start, used, over): requests of each window, and how many are over the limit; batch or stream."""
    rows = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    found = rows.groupBy(F.window(at, period), by).agg(F.count("*").alias("used"))
    return found.select(by, F.col("window.start").alias("window_start"), "used", F.greatest(F.col("used") - limit, F.lit(0)).alias("over"))
