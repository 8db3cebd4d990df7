"""Partial states of a table's rows, small enough to keep beside it and to be added up later."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.functions import decimal_round, unset_first
from tickloom.schema import PRICES, STOCKS

SUMMARY = T.StructType(
    [
        *STOCKS.fields,
        T.StructField("records", T.LongType()),
        T.StructField("spread_sum", T.DoubleType()),
        T.StructField("spread_rows", T.LongType()),
        T.StructField("fault", T.StringType()),
        T.StructField("trade_date", T.DateType()),
    ]
)


def summarize(rows: DataFrame) -> DataFrame:
    """One row per fault, UTC date and symbol: how many rows, the sum and number of known spreads, and the newest row.

    The newest row (a missing time counts as newest, see `latest_per_key`) keeps its own columns, so a summary has the
    shape of the table and the newest of several summaries is found as that of rows is. All buffers are of
    fixed width: one hash aggregate with a partial step.
    """
    newest = unset_first(rows, "timestamp")
    spread = F.col("high") - F.col("low")
    return rows.groupBy("fault", "trade_date", "symbol").agg(
        *(F.max_by(c, newest).alias(c) for c in (*PRICES, "timestamp")),
        F.count(F.lit(1)).alias("records"),
        F.sum(spread).alias("spread_sum"),
        F.count(spread).alias("spread_rows"),
    )


def summed_records(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"))


def summed_spread(summary: DataFrame) -> DataFrame:
    """Mean of high - low per symbol, widest first; no mean where no spread is known."""
    mean = F.try_divide(F.sum("spread_sum"), F.sum("spread_rows"))
    return (
        summary.groupBy("symbol")
        .agg(decimal_round(mean, 4).alias("avg_daily_spread"))
        .orderBy(F.desc("avg_daily_spread"), "symbol")
    )
