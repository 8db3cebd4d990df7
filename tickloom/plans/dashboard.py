"""The dashboard's four panels over a table shaped like `stocks`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators import (
    average_spread,
    latest_per_key,
    long_series,
    ohlc_bars,
    wide_series,
)
from tickloom.functions import utc_date
from tickloom.operators.series import Bound
from tickloom.operators.summary import summarize, summed_records, summed_spread
from tickloom.sinks.lake import read_stock_days, read_stock_summary


def total_records(stocks: DataFrame) -> DataFrame:
    return stocks.agg(F.count(F.lit(1)).alias("total_records"))


def latest_quotes(stocks: DataFrame) -> DataFrame:
    """The newest record per symbol under the panel's column titles."""
    newest = latest_per_key(stocks, ("close", "high", "low", "open", "timestamp"))
    return newest.select(
        "symbol",
        F.col("close").alias("Latest Close"),
        F.col("high").alias("Day High"),
        F.col("low").alias("Day Low"),
        F.col("open").alias("Day Open"),
        F.col("timestamp").alias("Last Updated"),
    ).orderBy("symbol")


def close_prices(stocks: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    return long_series(stocks, start, end)


def close_lines(
    stocks: DataFrame,
    symbols: Sequence[str],
    start: Bound = None,
    end: Bound = None,
    bucket: str | None = None,
) -> DataFrame:
    """The chart's lines: one column per symbol."""
    return wide_series(stocks, symbols, start, end, bucket=bucket)


def spreads(stocks: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    return average_spread(stocks, start, end)


def week_of_bars(ticks: DataFrame, width: str = "5 minutes", days: int = 7) -> DataFrame:
    """Bars from so many days before the newest one; the width must divide a day.

    Ticks are bounded by their own time at a bucket's edge, so the range reaches their scan and no
    bar is cut.
    """
    newest = ticks.agg(F.max("timestamp").alias("newest"))
    newest = newest.select(F.window("newest", width)["start"].alias("start"))
    edge = newest.select(F.col("start") - F.expr(f"INTERVAL {days} DAYS")).scalar()
    return ohlc_bars(ticks.where(F.col("timestamp") >= edge), width)


def last_days(days: int = 7) -> tuple[Column, Column]:
    """The range the dashboard opens with: so many days up to now."""
    now = F.current_timestamp()
    return now - F.expr(f"INTERVAL {days} DAYS"), now


def days_before_newest(stocks: DataFrame, days: int = 7) -> Column:
    """The start of a range that ends with the newest record, as a scalar subquery."""
    newest = stocks.agg(F.max("timestamp").alias("newest"))
    return newest.select(F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).scalar()


def total_from_summary(spark: SparkSession, path: str) -> DataFrame:
    """`total_records` of a table folder, from the summaries of its folds and the rows not folded yet."""
    return summed_records(read_stock_summary(spark, path))


def latest_from_summary(spark: SparkSession, path: str) -> DataFrame:
    """`latest_quotes` in the same way: a summary holds the newest row of its symbol and date."""
    return latest_quotes(read_stock_summary(spark, path))


def spreads_from_summary(spark: SparkSession, path: str, start: Bound, end: Bound) -> DataFrame:
    """`spreads` in the same way: whole days within the range from summaries, the first and the last day from rows."""
    low, high = (utc_date((b if isinstance(b, Column) else F.lit(b)).cast("timestamp")) for b in (start, end))
    whole = read_stock_summary(spark, path, lambda day: (day > low) & (day < high))
    rows = read_stock_days(spark, path, start, end, lambda day: (day == low) | (day == high))
    days = rows.withColumns({"fault": F.lit("ok"), "trade_date": utc_date(F.col("timestamp"))})
    return summed_spread(whole.unionByName(summarize(days)))
