from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(
    bootstrap: str,
    topic: str,
    starting_offsets: str = "earliest",
    fail_on_data_loss: bool = False,
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a topic subscription.

    A first start reads from `starting_offsets`; later ones go on where the checkpoint is.
    `min_partitions` splits few large topic partitions into more tasks, and
    `max_offsets_per_trigger` bounds a batch, the first one above all.
    """
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The topic as a stream; `value` holds the message bytes. Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**options).load()


def read_files(
    spark: SparkSession,
    path: str,
    stream: bool = True,
    whole_files: bool = False,
    max_files_per_trigger: int | None = None,
    fail_on_data_loss: bool = False,
) -> DataFrame:
    """Text files as messages in the column `value`: one per line, or one per file.

    `path` may be a glob, under which a stream also finds folders that appear later. Files that
    vanish between listing and reading are passed over, like messages past their retention, unless
    `fail_on_data_loss`.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.option("wholetext", str(whole_files).lower())
    reader = reader.option("ignoreMissingFiles", str(not fail_on_data_loss).lower())
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format("text").load(path)
