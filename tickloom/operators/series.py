"""Price series, long (one row per time and symbol) or wide (one column per symbol)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import time_range

Bound = str | datetime | Column | None


def long_series(
    stocks: DataFrame, start: Bound = None, end: Bound = None, value: str = "close"
) -> DataFrame:
    """`time, metric, <value>` in time order.

    The whole result is sorted by range partitioning. The row number as last key lets Spark cut
    a run of equal rows into several partitions.
    """
    return (
        time_range(stocks, "timestamp", start, end)
        .select(F.col("timestamp").alias("time"), F.col("symbol").alias("metric"), value)
        .withColumn("_cut", F.monotonically_increasing_id())
        .orderBy("time", "metric", value, "_cut")
        .drop("_cut")
    )


def wide_series(
    stocks: DataFrame,
    symbols: Sequence[str],
    start: Bound = None,
    end: Bound = None,
    value: str = "close",
    bucket: str | None = None,
) -> DataFrame:
    """One row per time with a column per symbol, holding the last value in that time (bucket).

    The caller names the symbols, so no pass is needed to find them; one aggregate gives all
    columns, where pivot() would shuffle twice.
    """
    rows = time_range(stocks, "timestamp", start, end).where(F.col("timestamp").isNotNull())
    rows = rows.where(F.col("symbol").isin(list(symbols)))
    time = F.window("timestamp", bucket)["start"] if bucket else F.col("timestamp")
    columns = (
        F.max_by(value, F.when(F.col("symbol") == s, F.col("timestamp"))).alias(s) for s in symbols
    )
    return (
        rows.select("symbol", "timestamp", value, time.alias("time"))
        .groupBy("time")
        .agg(*columns)
        .orderBy("time")
    )
