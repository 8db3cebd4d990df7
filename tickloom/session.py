"""Session settings, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "tickloom", timezone: str = "UTC", **conf: str) -> SparkSession:
    """A session for the jobs here. Master and resources come from spark-submit.

    Zone-less timestamps in messages are read in `timezone`.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", timezone)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


@contextmanager
def session_conf(spark: SparkSession, **conf: str | None) -> Iterator[None]:
    """Set SQL settings for a block; a query started inside keeps its own copy of them.

    Dots in keys are written as double underscores. None leaves a setting as it is.
    """
    wanted = {k.replace("__", "."): v for k, v in conf.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{root.rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"
