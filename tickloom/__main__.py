"""Command line for spark-submit: `run`, `ingest`, `fold` and `panel`."""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import time_range
from tickloom.plans import dashboard, statements
from tickloom.schema import SYMBOLS
from tickloom.session import build_session
from tickloom.sinks import (
    AGGREGATES_TABLE,
    STOCKS_TABLE,
    JdbcTarget,
    publish_files,
    publish_kafka,
)
from tickloom.sinks.lake import read_stocks
from tickloom.sources import kafka_options, read_files, read_kafka, read_table
from tickloom.streaming import (
    BatchLog,
    PipelineConfig,
    ingest_documents,
    start_pipeline,
    supervise,
)

# Fixed value: the topic the messages go through.
TOPIC = "stock_analysis"
# The panels that look at a time range.
RANGED = ("series", "lines", "spread")
PANELS = {
    "total": lambda stocks, a: dashboard.total_records(stocks),
    "latest": lambda stocks, a: dashboard.latest_quotes(stocks),
    "series": lambda stocks, a: dashboard.close_prices(stocks),
    "lines": lambda stocks, a: dashboard.close_lines(stocks, a.symbols, bucket=a.bucket),
    "spread": lambda stocks, a: dashboard.spreads(stocks),
}
# Panels over tables that are answered from the summaries of their folds.
SUMMED = {
    "total": lambda spark, path, start, end: dashboard.total_from_summary(spark, path),
    "latest": lambda spark, path, start, end: dashboard.latest_from_summary(spark, path),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tickloom")
    top.add_argument("--timezone", default="UTC", help="zone of zone-less timestamps")
    commands = top.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="messages into the two tables")
    _add_messages(run)
    run.add_argument("--checkpoint", required=True, help="durable shared folder")
    run.add_argument("--tables", required=True, help="durable shared folder")
    run.add_argument("--width", default="1 minute")
    run.add_argument("--watermark", default="2 minutes")
    run.add_argument("--trigger", default="30 seconds")
    run.add_argument("--once", action="store_true", help="process what is there and end")
    run.add_argument("--dedup", action="store_true", help="count a bar sent again once")
    run.add_argument("--keep-malformed", action="store_true")
    run.add_argument("--state-partitions", type=int)
    run.add_argument("--min-partitions", type=int)
    run.add_argument("--max-per-trigger", type=int, help="offsets or files per batch")
    _add_database(run, "write to a database")

    ingest = commands.add_parser("ingest", help="landed documents into messages, then end")
    _add_messages(ingest)
    ingest.add_argument("--documents", required=True, help="folder or glob of text files")
    ingest.add_argument("--whole-files", action="store_true", help="one document per file")
    ingest.add_argument("--checkpoint", required=True)
    ingest.add_argument("--quarantine", required=True)
    ingest.add_argument("--symbols", nargs="*", default=list(SYMBOLS), help="none given: all")
    ingest.add_argument("--max-per-trigger", type=int)
    ingest.add_argument("--ledger", help="folder of what was published: a bar is sent once")

    fold = commands.add_parser("fold", help="rewrite micro-batches as larger files")
    fold.add_argument("--tables", required=True)
    fold.add_argument("--merge", action="store_true", help="gather the dates that the folds touch")
    fold.add_argument("--expire", action="store_true", help="delete what was folded or merged before")

    panel = commands.add_parser("panel", help="answer one of the dashboard's questions")
    panel.add_argument("name", choices=sorted(PANELS))
    where = panel.add_mutually_exclusive_group(required=True)
    where.add_argument("--tables")
    _add_database(where, "read from a database")
    panel.add_argument("--start")
    panel.add_argument("--end")
    panel.add_argument("--days", type=int, default=7, help="the last days up to now, where no range is given")
    panel.add_argument("--symbols", nargs="+", default=list(SYMBOLS))
    panel.add_argument("--bucket", help="width of a point in time of the lines")
    panel.add_argument("--keep-malformed", action="store_true")
    panel.add_argument("--out", help="Parquet folder; without it the first rows are printed")
    return top


def _add_messages(command: argparse.ArgumentParser) -> None:
    where = command.add_mutually_exclusive_group(required=True)
    where.add_argument("--bootstrap", help="Kafka servers")
    where.add_argument("--files", help="folder of message files")
    command.add_argument("--topic", default=TOPIC)


def _add_database(command, purpose: str) -> None:
    login = "user and password are in JDBC_USER and JDBC_PASSWORD"
    command.add_argument("--jdbc-url", help=f"{purpose}; {login}")


def _database(args: argparse.Namespace) -> JdbcTarget | None:
    if not args.jdbc_url:
        return None
    return JdbcTarget(args.jdbc_url, os.environ["JDBC_USER"], os.environ["JDBC_PASSWORD"])


def _config(args: argparse.Namespace) -> PipelineConfig:
    return PipelineConfig(
        checkpoint=args.checkpoint,
        tables=args.tables,
        width=args.width,
        watermark=args.watermark,
        trigger=None if args.once else args.trigger,
        dedup=args.dedup,
        keep_malformed=args.keep_malformed,
        state_partitions=args.state_partitions,
        jdbc=_database(args),
    )


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.bootstrap:
        options = kafka_options(
            args.bootstrap,
            args.topic,
            min_partitions=args.min_partitions,
            max_offsets_per_trigger=args.max_per_trigger,
        )
        messages = read_kafka(spark, options)
    else:
        path = f"{args.files}/run=*"
        messages = read_files(spark, path, max_files_per_trigger=args.max_per_trigger)
    supervise(start_pipeline(spark, messages, _config(args)), bounded=args.once)


def _ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    def publish(messages: DataFrame, run: int) -> None:
        if args.bootstrap:
            publish_kafka(messages, args.bootstrap, args.topic)
        else:
            publish_files(messages, args.files, run)

    documents = read_files(
        spark,
        args.documents,
        whole_files=args.whole_files,
        max_files_per_trigger=args.max_per_trigger,
    )
    query = ingest_documents(
        spark, documents, publish, args.checkpoint, args.quarantine, args.symbols, args.ledger
    )
    supervise([query], bounded=True)


def _fold(spark: SparkSession, args: argparse.Namespace) -> None:
    config = PipelineConfig(checkpoint="", tables=args.tables)
    for table, path in ((STOCKS_TABLE, config.stocks), (AGGREGATES_TABLE, config.aggregates)):
        print(f"{path}: folded up to version {table.fold(spark, path)}")
        if args.merge:
            print(f"{path}: merged up to version {table.merge(spark, path)}")
        if args.expire:
            print(f"{path}: {table.expire(spark, path)} folders deleted")


def _panel(spark: SparkSession, args: argparse.Namespace) -> None:
    bounds = (None, None)
    if args.name in RANGED:
        given = args.start or args.end
        bounds = (args.start, args.end) if given else dashboard.last_days(args.days)
    database = _database(args)
    if database and args.name in statements.PANELS:
        _show(statements.ask(spark, database, args.name, *_instants(spark, bounds)), args)
        return
    if database:
        table = read_table(spark, database, "stocks", "timestamp")
        stocks = time_range(table, "timestamp", *bounds)
    else:
        path = PipelineConfig(checkpoint="", tables=args.tables).stocks
        if args.name in SUMMED and not args.keep_malformed:
            _show(SUMMED[args.name](spark, path, *bounds), args)
            return
        stocks = read_stocks(spark, path, *bounds, keep_malformed=args.keep_malformed)
    _show(PANELS[args.name](stocks, args), args)


def _instants(spark: SparkSession, bounds: tuple) -> list:
    """The range's ends as times that a statement can hold."""
    if all(b is None or isinstance(b, str) for b in bounds):
        return list(bounds)
    return list(spark.range(1).select(*(b.cast("timestamp_ntz") for b in bounds)).first())


def _show(result: DataFrame, args: argparse.Namespace) -> None:
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(truncate=False)


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(timezone=args.timezone)
    if args.command in ("run", "ingest"):
        logger = logging.getLogger("tickloom")
        logger.setLevel(logging.INFO)
        logger.addHandler(logging.StreamHandler())
        spark.streams.addListener(BatchLog())
    {"run": _run, "ingest": _ingest, "fold": _fold, "panel": _panel}[args.command](spark, args)


if __name__ == "__main__":
    main()
