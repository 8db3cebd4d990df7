"""Record layouts shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the wire message and of the two tables.
PRICES = ("open", "high", "low", "close")

WIRE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

STOCKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

AGGREGATES = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("avg_close", T.DoubleType()),
        T.StructField("min_low", T.DoubleType()),
        T.StructField("max_high", T.DoubleType()),
        T.StructField("trade_count", T.LongType()),
    ]
)
AGGREGATE_KEY = ("window_start", "symbol")

# The vendor document and the keys of one bar in it.
PAYLOAD_META = "Meta Data"
PAYLOAD_SYMBOL = "2. Symbol"
PAYLOAD_SERIES = "Time Series (5min)"
PAYLOAD_BAR = {"open": "1. open", "high": "2. high", "low": "3. low", "close": "4. close"}

PAYLOAD = T.StructType(
    [
        T.StructField(PAYLOAD_META, T.StructType([T.StructField(PAYLOAD_SYMBOL, T.StringType())])),
        T.StructField(
            PAYLOAD_SERIES,
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())),
        ),
    ]
)

# The symbols the feed is restricted to.
SYMBOLS = ("KOS", "TROX", "WTI", "AAPL", "TSLA")

CORRUPT = "_corrupt"


def with_corrupt(schema: T.StructType) -> T.StructType:
    """The schema plus the column in which from_json reports unusable text."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
