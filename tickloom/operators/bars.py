"""Single ticks to OHLC bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ohlc_bars(ticks: DataFrame, width: str = "5 minutes", time: str = "timestamp") -> DataFrame:
    """One bar per symbol and bucket, stamped with the start of the bucket."""
    return (
        ticks.groupBy("symbol", F.window(time, width).alias("bucket"))
        .agg(
            F.min_by("open", time).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", time).alias("close"),
        )
        .select("symbol", "open", "high", "low", "close", F.col("bucket.start").alias(time))
    )
