"""A bounded run over landed vendor documents: each is read once, its bars become messages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import accepted, keep_symbols, quarantined, unpivot_payloads
from tickloom.schema import PRICES
from tickloom.sinks import fs, to_messages
from tickloom.sinks.jdbc import checkpoint_id

Publish = Callable[[DataFrame, str], None]

#: What the ledger keeps of a published bar.
LEDGER = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content", T.LongType())])


def not_published(spark: SparkSession, bars: DataFrame, ledger: str, run: str) -> DataFrame:
    """The bars, each once, that no run but this one has published with the same prices; `content` is their hash.

    The ledger is one folder per run, and a run that is repeated does not see its own. Only entries that have a
    bar of this batch are kept of it, a semi join with the batch's own keys: bounds on their times reach the ledger's
    files, and at size Spark sends a Bloom filter of the keys into its scan.
    """
    keys = ["symbol", "date", "content"]
    bars = bars.withColumn("content", F.xxhash64(*PRICES)).dropDuplicates(keys)
    runs = [p for p in fs.glob(spark, f"{ledger}/run=*/_SUCCESS") if f"/run={run}/" not in p]
    if not runs:
        return bars
    published = spark.read.schema(LEDGER).parquet(*(p.removesuffix("/_SUCCESS") for p in runs))
    ends = bars.agg(F.min("date").alias("low"), F.max("date").alias("high")).first()
    published = published.where(F.col("date").between(F.lit(ends["low"]), F.lit(ends["high"])))
    known = published.join(bars.select(keys), keys, "left_semi")
    return bars.join(known, keys, "left_anti")


def ingest_documents(
    spark: SparkSession,
    documents: DataFrame,
    publish: Publish,
    checkpoint: str,
    quarantine: str,
    symbols: Sequence[str] | None = None,
    ledger: str | None = None,
) -> StreamingQuery:
    """Turn the documents that have arrived since the last run into messages, and end.

    `documents` is a stream with the column `value`. `publish(messages, run)` gets a name of
    the batch, made of the checkpoint's lasting id and the batch number: it is the same when a batch is
    repeated, and no other ingest has it. Documents and bars that
    cannot be used go to `quarantine/run=<run>` with their text; they do not stop the run.

    Vendors send a whole series again each time, and all its bars become messages again. With a `ledger`
    folder a bar is published once, and again only if its prices have changed (see `not_published`).
    """
    owner = checkpoint_id(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = f"{owner}-{batch_id:010d}"
        flat = unpivot_payloads(batch).persist()
        try:
            bars = accepted(flat)
            if symbols:
                bars = keep_symbols(bars, symbols)
            if ledger:
                bars = not_published(spark, bars, ledger, run)
            publish(to_messages(bars, "date"), run)
            if ledger:
                bars.select(*LEDGER.names).write.mode("overwrite").parquet(f"{ledger}/run={run}")
            rejected = quarantined(flat).select("symbol", "date", "fault", "raw_value")
            rejected.write.mode("overwrite").parquet(f"{quarantine}/run={run}")
        finally:
            flat.unpersist()

    return (
        documents.select(F.col("value"))
        .writeStream.foreachBatch(write)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .start()
    )
