"""Newest row per key, newest known value, newest version of a keyed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import unset_first


def latest_per_key(
    rows: DataFrame, columns: Sequence[str], key: str = "symbol", time: str = "timestamp"
) -> DataFrame:
    """One row per key, the one with the newest time; a missing time counts as newest.

    All columns come from the same row. Which of several rows with equal times it is, is open.
    One hash aggregate with a partial step: no sort, and one row per key and partition shuffled.
    """
    newest = unset_first(rows, time)
    wanted = [c for c in columns if c != key]
    return rows.groupBy(key).agg(*(F.max_by(c, newest).alias(c) for c in wanted))


def last_not_null(
    rows: DataFrame, value: str, key: str = "symbol", time: str = "timestamp"
) -> DataFrame:
    """The newest known `value` per key; keys without any known value fall out."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.max_by(value, unset_first(rows, time)).alias(value))


def newest_version(rows: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The row written last per key, with its version; `version` is a bigint without ties."""
    values = [c for c in rows.columns if c not in (*keys, version)]
    return rows.groupBy(*keys).agg(
        *(F.max_by(c, version).alias(c) for c in values), F.max(version).alias(version)
    )
