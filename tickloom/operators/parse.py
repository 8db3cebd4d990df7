"""JSON messages to typed rows, each with the reason why it is unusable, if it is."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import decode_text, json_struct
from tickloom.schema import CORRUPT, PRICES, WIRE

OK = "ok"


def parse_messages(messages: DataFrame, value: str = "value", carry: Sequence[str] = ()) -> DataFrame:
    """`symbol, open, high, low, close, event_time, fault, raw_value`, one row per message.

    fault is ok, empty (nothing to parse), malformed (no JSON object, or a field of the wrong
    type), bad_time or missing_field. raw_value keeps the message bytes of the rows that are not
    ok. Fields that could be read are kept in any case. Columns to `carry` come last.
    """
    data = messages.select(
        *carry,
        F.col(value).cast("binary").alias("raw_value"),
        json_struct(decode_text(F.col(value)), WIRE).alias("data"),
    ).withColumn("event_time", _event_time(F.col("data.timestamp")))

    missing = reduce(or_, (F.col(f"data.{c}").isNull() for c in ("symbol", *PRICES)))
    fault = (
        F.when(F.col("data").isNull(), "empty")
        .when(F.col(f"data.{CORRUPT}").isNotNull(), "malformed")
        .when(F.col("event_time").isNull(), "bad_time")
        .when(missing, "missing_field")
        .otherwise(OK)
    )
    return data.select(
        *(F.col(f"data.{c}").alias(c) for c in ("symbol", *PRICES)),
        "event_time",
        fault.alias("fault"),
        F.when(fault != OK, F.col("raw_value")).alias("raw_value"),
        *carry,
    )


def _event_time(text: Column) -> Column:
    """Text to an instant, NULL without a full date: a bare clock time would be read as today's."""
    return F.when(text.rlike(r"^\s*\d{4,6}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fault") == OK)


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fault") != OK)
