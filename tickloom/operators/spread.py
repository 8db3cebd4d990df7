"""How far prices move within a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import decimal_round, time_range
from tickloom.operators.series import Bound


def average_spread(stocks: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """Mean of high - low per symbol over a time range, widest first."""
    return (
        time_range(stocks, "timestamp", start, end)
        .groupBy("symbol")
        .agg(decimal_round(F.avg(F.col("high") - F.col("low")), 4).alias("avg_daily_spread"))
        .orderBy(F.desc("avg_daily_spread"), "symbol")
    )
