"""The given tables in the shape of `stocks`, and messages and documents made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators import ohlc_bars
from tickloom.operators.parse import OK
from tickloom.schema import PRICES


def ticks(events: DataFrame) -> DataFrame:
    """events: one symbol per event type; a tick's four prices are its value."""
    return events.select(
        F.col("event_type").alias("symbol"),
        *(F.col("value").alias(c) for c in PRICES),
        F.col("ts").alias("timestamp"),
    )


def read_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of parsed messages; a watermark wants the time as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The stream source lists a folder or a glob, no single file.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return ticks(events).select(
        "symbol",
        *PRICES,
        F.col("timestamp").cast("timestamp").alias("event_time"),
        F.lit(OK).alias("fault"),
        F.lit(None).cast("binary").alias("raw_value"),
    )


def read_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc_bars(read_ticks(spark, sf_dir), "5 minutes")


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a larger tick table: one symbol per return flag and line status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        *(F.col("l_extendedprice").alias(c) for c in PRICES),
        F.col("l_shipdate").alias("timestamp"),
    )


def spoilt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks as messages; the event number decides which message is spoilt, and how."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 97
    fields = {
        "symbol": F.col("event_type"),
        **{c: F.col("value") for c in PRICES},
        "timestamp": F.col("ts").cast("string"),
    }

    def message(**changed: Column | None) -> Column:
        kept = {k: v for k, v in {**fields, **changed}.items() if v is not None}
        return F.to_json(F.struct(*(v.alias(k) for k, v in kept.items())))

    text = (
        F.when(kind == 0, "not json")
        .when(kind == 1, "")
        .when(kind == 2, F.lit(None).cast("string"))
        .when(kind == 3, "[]")
        .when(kind == 4, F.expr("left(props, 5)"))
        .when(kind == 5, message(timestamp=F.lit("nope")))
        .when(kind == 6, message(high=None))
        .when(kind == 7, message(open=F.lit("1.0")))
        .when(kind == 8, message(symbol=None))
        .otherwise(message())
    )
    return events.select(text.cast("binary").alias("value"))
