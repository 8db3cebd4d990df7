"""Replay-safe Parquet tables, JDBC tables, and messages."""

from tickloom.sinks.jdbc import JdbcTarget, checkpoint_id, write_once, write_upsert
from tickloom.sinks.lake import AGGREGATES_TABLE, STOCKS_TABLE, LakeTable, open_epoch, version_of
from tickloom.sinks.messages import publish_files, publish_kafka, to_messages

__all__ = [
    "AGGREGATES_TABLE",
    "STOCKS_TABLE",
    "JdbcTarget",
    "LakeTable",
    "checkpoint_id",
    "open_epoch",
    "publish_files",
    "publish_kafka",
    "to_messages",
    "version_of",
    "write_once",
    "write_upsert",
]
