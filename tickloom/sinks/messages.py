"""Flat records to JSON messages, on a topic or in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import encode_wire


def to_messages(records: DataFrame, time: str = "timestamp") -> DataFrame:
    """One JSON text per record in the column `value`; messages have no key."""
    return records.select(encode_wire(F.col(time)).alias("value"))


def publish_files(messages: DataFrame, path: str, run: str) -> None:
    """Write the messages of one run as text lines; repeating the run replaces its files."""
    messages.write.mode("overwrite").text(f"{path}/run={run}")


def publish_kafka(messages: DataFrame, bootstrap: str, topic: str) -> None:
    kafka = {"kafka.bootstrap.servers": bootstrap, "topic": topic}
    messages.write.format("kafka").options(**kafka).save()
