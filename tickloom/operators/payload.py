"""Vendor documents, in which the bars of one symbol hang under their times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import json_struct, price
from tickloom.operators.parse import OK
from tickloom.schema import (
    CORRUPT,
    PAYLOAD,
    PAYLOAD_BAR,
    PAYLOAD_META,
    PAYLOAD_SERIES,
    PAYLOAD_SYMBOL,
    PRICES,
)


def _last_wins(series: Column) -> Column:
    """Entries of a JSON object; where a key is repeated, only its last entry counts.

    Keys are sorted with their places, so that each meets its successor. No lambda refers to a whole
    array, which Spark would make again for each element.
    """
    entries = F.map_entries(series)
    places = F.transform(F.map_keys(series), lambda key, i: F.struct(key.alias("key"), i.alias("place")))
    order = F.sort_array(places)
    marks = F.zip_with(
        order,
        F.slice(order, 2, F.size(order)),
        lambda at, after: F.struct(
            at["place"].alias("place"), (~F.equal_null(after["key"], at["key"])).alias("last")
        ),
    )
    kept = F.zip_with(entries, F.sort_array(marks), lambda entry, mark: F.when(mark["last"], entry))
    return F.filter(kept, lambda entry: entry.isNotNull())


def _last_value(bar: Column, key: str) -> Column:
    """A bar's value; like in the series, the last of repeated keys counts."""
    found = F.filter(F.map_entries(bar), lambda entry: entry["key"] == key)
    return F.try_element_at(found, F.lit(-1))["value"]


def unpivot_payloads(documents: DataFrame, value: str = "value") -> DataFrame:
    """`symbol, date, open, high, low, close, fault, raw_value`, one row per bar.

    A document that cannot be used gives one row with its fault (empty, malformed, no_metadata,
    no_series) and its text; a bar without four numeric prices gives a row with fault bad_bar and
    the text of the bar (`null` for a bar that is null). Of repeated keys the last counts, among
    the bars and within one. One document is one row here: nothing is gathered across documents.
    """
    data = documents.select(
        F.col(value).cast("string").alias("text"),
        json_struct(F.col(value).cast("string"), PAYLOAD).alias("data"),
    )
    symbol = F.col(f"data.`{PAYLOAD_META}`.`{PAYLOAD_SYMBOL}`")
    series = F.col(f"data.`{PAYLOAD_SERIES}`")
    document_fault = (
        F.when(F.col("data").isNull(), "empty")
        .when(F.col(f"data.{CORRUPT}").isNotNull(), "malformed")
        .when(symbol.isNull(), "no_metadata")
        .when(series.isNull(), "no_series")
    )
    entries = _last_wins(series)
    no_bar = F.array(F.lit(None).cast("struct<key:string,value:map<string,string>>"))
    bars = data.select(
        symbol.alias("symbol"),
        document_fault.alias("document_fault"),
        F.when(document_fault.isNotNull(), F.col("text")).alias("text"),
        F.explode(F.when(document_fault.isNull(), entries).otherwise(no_bar)).alias("bar"),
    )
    flat = bars.select(
        "symbol",
        F.col("bar.key").alias("date"),
        *(price(_last_value(F.col("bar.value"), PAYLOAD_BAR[c])).alias(c) for c in PRICES),
        "document_fault",
        "text",
        F.col("bar.value").alias("bar"),
    )
    unusable = F.greatest(*(F.col(c).isNull() for c in PRICES))
    return flat.select(
        "symbol",
        "date",
        *PRICES,
        F.coalesce("document_fault", F.when(unusable, "bad_bar"), F.lit(OK)).alias("fault"),
        F.when(F.col("document_fault").isNotNull(), F.col("text"))
        .when(unusable, F.coalesce(F.to_json("bar"), F.lit("null")))
        .alias("raw_value"),
    )


def build_payloads(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """Flat bars to vendor documents (`value`), one per symbol and day.

    Bars must be unique per symbol and 5 minutes, so that a document holds 288 of them at most.
    """
    bar = F.create_map(
        *(x for c in PRICES for x in (F.lit(PAYLOAD_BAR[c]), F.col(c).cast("string")))
    )
    entry = F.struct(F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("key"), bar.alias("value"))
    return (
        bars.groupBy("symbol", F.to_date(time).alias("day"))
        .agg(F.map_from_entries(F.collect_list(entry)).alias("series"))
        .select(
            F.to_json(
                F.struct(
                    F.struct(F.col("symbol").alias(PAYLOAD_SYMBOL)).alias(PAYLOAD_META),
                    F.col("series").alias(PAYLOAD_SERIES),
                )
            ).alias("value")
        )
    )
