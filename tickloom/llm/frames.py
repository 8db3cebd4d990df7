"""Shared by the operators: Arrow maps that carry the rows along, and tables in the cluster's shared folder.

Operators return the columns they were asked to carry in a struct `row`, so that no name among the given
columns can clash with theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sinks import fs

TextFunction = Callable[[pa.Array], dict[str, pa.Array]]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, carry: list[str] | None) -> list[str]:
    return docs.columns if carry is None else list(carry)


def row_of(docs: DataFrame, carry: list[str] | None):
    """The carried columns as a struct."""
    return F.struct(*(docs[quoted(c)] for c in carried(docs, carry)))


def map_texts(
    docs: DataFrame,
    function: TextFunction,
    fields: str,
    text_col: str = "text",
    carry: list[str] | None = None,
    most: int | None = None,
) -> DataFrame:
    """`row` and what `function` makes of each Arrow batch of texts, in the same order.

    `fields` is the schema of the function's columns. Spark deals the rows out; a batch is bounded by
    spark.sql.execution.arrow.maxRecordsPerBatch, and cut to `most` rows if given.
    """
    kept = carried(docs, carry)
    given = docs.select(
        F.struct(*(docs[quoted(c)] for c in kept)).alias("row"),
        *([] if text_col in kept else [docs[quoted(text_col)].cast("string").alias("text")]),
    )
    added = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    schema = T.StructType([T.StructField("row", given.schema["row"].dataType), *added.fields])
    place = kept.index(text_col) if text_col in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, most or max(whole.num_rows, 1)):
                batch = whole.slice(first, most)
                rows = batch.column(0)
                texts = batch.column(1) if place is None else rows.field(place)
                made = function(texts)
                yield pa.RecordBatch.from_arrays([rows, *(made[f.name] for f in added.fields)], ["row", *added.names])

    return given.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"{root.rstrip('/')}/tickloom-{name}-{uuid.uuid4().hex}"


#: Folders of the tables stored by this driver.
_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, stored; the tables that were stored on the way to it are deleted."""
    before = len(_stored)
    out = stored(make(), name)
    for path in _stored[before:-1]:
        fs.delete(spark, path)
    del _stored[before:-1]
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
