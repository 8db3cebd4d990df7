from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.schema import CORRUPT, PRICES, with_corrupt

# The latest instant Spark's microsecond timestamps can hold, as a number and as zone-less text.
LAST_MICROSECOND = 2**63 - 1
END_OF_TIME = "294247-01-10 04:00:54.775807"


def decode_text(value: Column) -> Column:
    """Message bytes to text."""
    return value.cast("string")


def json_struct(text: Column, schema: T.StructType) -> Column:
    """Parse JSON text exactly once per row.

    Without the one-element explode Catalyst copies from_json into every filter and projection
    that reads a parsed field, so each row is parsed several times. Goes into a select.
    """
    parsed = F.from_json(text, with_corrupt(schema), {"columnNameOfCorruptRecord": CORRUPT})
    return F.explode(F.array(parsed))


def price(text: Column) -> Column:
    """Text to double; NULL where it is no number, where a plain cast would end the job.

    The cast would also take Java's type suffix, as in 1.5f.
    """
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))


def decimal_round(value: Column, scale: int) -> Column:
    """Round half away from zero on the decimal value, returned as double.

    A value that a decimal cannot hold is returned as it is: at its size rounding changes nothing.
    """
    return F.coalesce(F.round(value.try_cast("decimal(38,10)"), scale).cast("double"), value)


def encode_wire(time: Column) -> Column:
    """One record as the JSON text of a message; the columns are those of the flat record."""
    return F.to_json(F.struct("symbol", *PRICES, time.cast("string").alias("timestamp")))


def time_literal(df: DataFrame, column: str, value: str | datetime | Column) -> Column:
    """A bound in the column's own timestamp type, so that comparing needs no cast of the column
    and the filter reaches the scan."""
    bound = value if isinstance(value, Column) else F.lit(value)
    return bound.cast(df.schema[column].dataType)


def utc_date(time: Column) -> Column:
    """The date of an instant in UTC, whatever the session's zone, for partition folders."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))


def time_range(
    df: DataFrame,
    column: str,
    start: str | datetime | Column | None = None,
    end: str | datetime | Column | None = None,
    date_column: str | None = None,
) -> DataFrame:
    """Rows with `start <= column <= end`; either bound may be left out.

    `date_column` names a partition column holding the UTC date of `column`: it gets the same
    bounds, so that whole partitions are skipped.
    """
    if start is not None:
        low = time_literal(df, column, start)
        df = df.where(F.col(column) >= low)
        if date_column:
            df = df.where(F.col(date_column) >= utc_date(low))
    if end is not None:
        high = time_literal(df, column, end)
        df = df.where(F.col(column) <= high)
        if date_column:
            df = df.where(F.col(date_column) <= utc_date(high))
    return df


def unset_first(df: DataFrame, column: str) -> Column:
    """Ordering key under which a missing time counts as the newest.

    It stays a plain timestamp, which keeps max_by in a hash aggregate; ordering by a struct
    would sort every input partition.
    """
    kind = df.schema[column].dataType
    # The text would be read in the session's zone, and does not fit west of UTC.
    zoned = isinstance(kind, T.TimestampType)
    last = F.timestamp_micros(F.lit(LAST_MICROSECOND)) if zoned else F.lit(END_OF_TIME).cast(kind)
    return F.coalesce(F.col(column), last)
