"""Restriction to the symbols of interest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from tickloom.schema import SYMBOLS


def keep_symbols(rows: DataFrame, symbols: Iterable[str] = SYMBOLS) -> DataFrame:
    """Rows of the given symbols; the filter reaches the scan."""
    return rows.where(F.col("symbol").isin(list(symbols)))


def keep_listed(rows: DataFrame, listed: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Rows whose symbol occurs in a table.

    The list is measured first, by a job that runs when the frame is built: one that fits is broadcast, so that the rows stay where they are.
    A larger one is joined by shuffle, where Spark splits hot symbols at run time.
    """
    names = listed.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    size = names.agg(F.sum(F.octet_length("symbol") + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        names = F.broadcast(names)
    return rows.join(names, "symbol", "left_semi")
