"""Messages into two tables: every record, and aggregates per window and symbol.

The tables are fed by two queries with a checkpoint each, so one may be ahead of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import accepted, parse_messages, quarantined, window_aggregate
from tickloom.schema import AGGREGATE_KEY, AGGREGATES, STOCKS
from tickloom.session import ROCKSDB, session_conf
from tickloom.sinks import (
    AGGREGATES_TABLE,
    STOCKS_TABLE,
    JdbcTarget,
    checkpoint_id,
    open_epoch,
    version_of,
    write_once,
    write_upsert,
)
from tickloom.sinks.jdbc import without_key
from tickloom.streaming.progress import WRITTEN


@dataclass(frozen=True)
class PipelineConfig:
    """Where the pipeline keeps things, and its settings.

    Both folders must be durable and reachable by all executors; there is no default for them.
    `trigger=None` processes what is there and ends. `state_partitions` is fixed by the first
    batch of a checkpoint: choose it for the size the state will have.
    """

    checkpoint: str
    tables: str
    width: str = "1 minute"
    watermark: str = "2 minutes"
    trigger: str | None = "30 seconds"
    output_mode: str = "update"
    dedup: bool = False
    keep_malformed: bool = False
    state_partitions: int | None = None
    aggregate_files: int | None = None
    jdbc: JdbcTarget | None = None

    @property
    def stocks(self) -> str:
        return f"{self.tables}/stocks"

    @property
    def aggregates(self) -> str:
        return f"{self.tables}/stocks_aggregates_1m"


def start_pipeline(
    spark: SparkSession, messages: DataFrame, config: PipelineConfig
) -> list[StreamingQuery]:
    """Start both queries over a stream of messages (column `value`)."""
    parsed = parse_messages(messages)
    raw = start_raw(spark, parsed, config)
    try:
        return [raw, start_aggregates(spark, parsed, config)]
    except Exception:
        raw.stop()
        raise


def start_raw(spark: SparkSession, parsed: DataFrame, config: PipelineConfig) -> StreamingQuery:
    """Append every record to `stocks`; unusable messages are kept there with their fault.

    One write per batch serves both, so a batch is read and parsed once. With a database only the
    unusable messages are kept in the folder.
    """
    checkpoint = f"{config.checkpoint}/raw"
    epoch = open_epoch(spark, checkpoint, config.stocks)
    rows = parsed.withColumnRenamed("event_time", "timestamp").select(
        *STOCKS.names, "raw_value", "fault"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        version = version_of(epoch, batch_id)
        if not config.jdbc:
            STOCKS_TABLE.write_batch(batch, config.stocks, version)
            return
        batch = batch.persist()
        try:
            STOCKS_TABLE.write_batch(quarantined(batch), config.stocks, version)
            usable = batch if config.keep_malformed else accepted(batch)
            name = f"{checkpoint_id(spark, checkpoint)}/{batch_id}"
            write_once(usable.select(STOCKS.names), config.jdbc, "stocks", name)
        finally:
            batch.unpersist()

    return _start(spark, rows, "append", write, checkpoint, config, config.stocks)


def start_aggregates(
    spark: SparkSession, parsed: DataFrame, config: PipelineConfig
) -> StreamingQuery:
    """Keep `stocks_aggregates_1m` up to date with the windows each batch has changed."""
    checkpoint = f"{config.checkpoint}/aggregates"
    epoch = open_epoch(spark, checkpoint, config.aggregates)
    rows = parsed if config.keep_malformed else accepted(parsed)
    rows = rows.select("symbol", "low", "high", "close", "event_time")
    windows = window_aggregate(rows, config.width, watermark=config.watermark, dedup=config.dedup)

    def write(batch: DataFrame, batch_id: int) -> None:
        version = version_of(epoch, batch_id)
        files = config.aggregate_files
        if not config.jdbc:
            AGGREGATES_TABLE.write_batch(batch, config.aggregates, version, files)
            return
        batch = batch.persist()
        try:
            # Windows without a symbol have no place under the database's key.
            AGGREGATES_TABLE.write_batch(
                without_key(batch, AGGREGATE_KEY), config.aggregates, version, files
            )
            name = f"{checkpoint_id(spark, checkpoint)}/{batch_id}"
            write_upsert(batch, config.jdbc, "stocks_aggregates_1m", AGGREGATE_KEY, name)
        finally:
            batch.unpersist()

    windows = windows.select(AGGREGATES.names)
    mode = config.output_mode
    return _start(spark, windows, mode, write, checkpoint, config, config.aggregates)


def _start(
    spark: SparkSession,
    rows: DataFrame,
    output_mode: str,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    config: PipelineConfig,
    name: str,
) -> StreamingQuery:
    # The count travels with the one write of the batch into the query's progress report.
    counted = rows.observe(WRITTEN, F.count(F.lit(1)).alias("rows"))
    trigger = {"processingTime": config.trigger} if config.trigger else {"availableNow": True}
    partitions = config.state_partitions
    # Counting the rows of the state costs a read per write, too much where it holds every bar.
    count_state = "false" if config.dedup else None
    with session_conf(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
        spark__sql__streaming__stateStore__rocksdb__trackTotalNumberOfRows=count_state,
        spark__sql__shuffle__partitions=str(partitions) if partitions else None,
    ):
        return (
            counted.writeStream.foreachBatch(write)
            .queryName(name)
            .outputMode(output_mode)
            .trigger(**trigger)
            .option("checkpointLocation", checkpoint)
            .start()
        )


def supervise(
    queries: Sequence[StreamingQuery], bounded: bool = False, poll_seconds: float = 1.0
) -> None:
    """Wait until a query ends, then stop the others; raise what made it fail.

    With `bounded`, queries that end of themselves are waited for until all have.
    """
    try:
        while True:
            for query in queries:
                if not query.isActive and query.exception():
                    raise query.exception()
            live = [q for q in queries if q.isActive]
            if not live or (not bounded and len(live) < len(queries)):
                return
            live[0].awaitTermination(poll_seconds)
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def run_caught_up(queries: Sequence[StreamingQuery]) -> None:
    """Let queries under a timed trigger take in all that is there now, then stop them.

    The end is told by their progress: each has processed what its source held when it was asked.
    """
    try:
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()


def run_available(spark: SparkSession, messages: DataFrame, config: PipelineConfig) -> None:
    """Process all messages that are there, as a scheduled run does, and return."""
    if config.trigger is not None:
        raise ValueError("a bounded run takes trigger=None")
    supervise(start_pipeline(spark, messages, config), bounded=True, poll_seconds=0.2)
