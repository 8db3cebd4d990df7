"""Every operator as a query over the given tables; `oracles.py` holds the SQL for each.

Times come back without zone and averages rounded, since sums of doubles depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions import decimal_round
from tickloom.operators import (
    accepted,
    build_payloads,
    keep_listed,
    keep_symbols,
    last_not_null,
    parse_messages,
    unpivot_payloads,
    wide_series,
    window_aggregate,
)
from tickloom.plans import dashboard, statements
from tickloom.plans.adapters import (
    line_ticks,
    read_bars,
    read_ticks,
    spoilt_messages,
    stream_ticks,
)
from tickloom.schema import PRICES
from tickloom.session import scratch_dir
from tickloom.sinks import AGGREGATES_TABLE, STOCKS_TABLE, fs, publish_files, to_messages
from tickloom.sinks.lake import read_aggregates, read_quarantine, read_stocks
from tickloom.sources import read_files
from tickloom.streaming import (
    PipelineConfig,
    ingest_documents,
    late_rows,
    lost_files,
    open_windows,
    run_available,
    run_caught_up,
    start_aggregates,
    start_raw,
    supervise,
    with_batches,
)

Query = Callable[[SparkSession, str], DataFrame]

# The event types of the given tables, which stand for symbols, and their time span.
EVENT_SYMBOLS = ("click", "error", "purchase", "signup", "view")
SPAN = ("2024-01-01", "2024-01-31")
PART = ("2024-01-05 10:30:00", "2024-01-24 16:05:00")


def _plain(df: DataFrame) -> DataFrame:
    """Instants to zone-less timestamps."""
    return df.select(
        *(
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )


def _rounded(windows: DataFrame) -> DataFrame:
    return _plain(windows.withColumn("avg_close", decimal_round(F.col("avg_close"), 6)))


# --- panels -------------------------------------------------------------------------------------


def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.latest_quotes(read_ticks(spark, sf_dir))


def latest_quotes_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.latest_quotes(read_bars(spark, sf_dir))


def total_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.total_records(read_ticks(spark, sf_dir))


def close_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.close_prices(read_ticks(spark, sf_dir), *SPAN)


def close_series_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = read_ticks(spark, sf_dir)
    return dashboard.close_prices(stocks, dashboard.days_before_newest(stocks))


def close_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_series(read_ticks(spark, sf_dir), EVENT_SYMBOLS, *SPAN)


def close_wide_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_series(read_ticks(spark, sf_dir), EVENT_SYMBOLS, *SPAN, bucket="1 hour")


def avg_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.spreads(read_bars(spark, sf_dir), *SPAN)


def avg_spread_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.spreads(dashboard.week_of_bars(read_ticks(spark, sf_dir)))


def last_known_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes under 20 count as unknown here, since the table has no missing ones."""
    known = F.when(F.col("close") >= 20, F.col("close"))
    return last_not_null(read_ticks(spark, sf_dir).withColumn("close", known), "close")


# --- filters, windows, bars ---------------------------------------------------------------------


def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_symbols(read_ticks(spark, sf_dir), ("click", "view"))


def symbol_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = read_ticks(spark, sf_dir)
    return keep_listed(stocks, stocks.where(F.col("symbol") < "p"))


def ohlc_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bars(spark, sf_dir)


def agg_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(window_aggregate(read_ticks(spark, sf_dir), "1 minute", "timestamp"))


def agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(window_aggregate(read_ticks(spark, sf_dir), "1 hour", "timestamp"))


def resent_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record twice: it counts twice."""
    stocks = read_ticks(spark, sf_dir)
    return _rounded(window_aggregate(stocks.unionAll(stocks), "1 hour", "timestamp"))


def dedup_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record twice: it counts once."""
    stocks = read_ticks(spark, sf_dir)
    sent = stocks.unionAll(stocks)
    return _rounded(window_aggregate(sent, "1 hour", "timestamp", dedup=True))


def agg_1m_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(window_aggregate(read_bars(spark, sf_dir), "1 minute", "timestamp"))


def agg_lines_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(window_aggregate(line_ticks(spark, sf_dir), "1 day", "timestamp"))


# --- messages and documents ---------------------------------------------------------------------


def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = to_messages(read_ticks(spark, sf_dir)).select(F.col("value").cast("binary"))
    parsed = accepted(parse_messages(messages)).withColumnRenamed("event_time", "timestamp")
    return _plain(parsed.select("symbol", *PRICES, "timestamp"))


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_messages(spoilt_messages(spark, sf_dir))
    return parsed.groupBy("fault").agg(F.count(F.lit(1)).alias("messages"))


def loose_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a row, unusable ones with the fields that could be read."""
    parsed = parse_messages(spoilt_messages(spark, sf_dir))
    rows = parsed.withColumnRenamed("event_time", "timestamp")
    return _plain(rows.select("symbol", *PRICES, "timestamp"))


def loose_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable messages with a time count too; those without a symbol form a group."""
    return _rounded(window_aggregate(parse_messages(spoilt_messages(spark, sf_dir)), "1 hour"))


def foreign_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed in which other JSON, whole pages and whole documents are mixed with the ticks."""

    def texts(table: str, column: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).alias("value"))

    feed = to_messages(read_ticks(spark, sf_dir))
    for other in (("events", "props"), ("pages", "html"), ("documents", "text")):
        feed = feed.unionByName(texts(*other))
    parsed = parse_messages(feed)
    return parsed.groupBy("fault").agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.octet_length("raw_value")), F.lit(0)).alias("kept_bytes"),
    )


def payload_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = accepted(unpivot_payloads(build_payloads(read_bars(spark, sf_dir))))
    return flat.select("symbol", *PRICES, F.col("date").cast("timestamp_ntz").alias("timestamp"))


def payload_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name every bar twice, the first time without a high; the last counts."""
    parts = r'(?s)^(.*?"Time Series \(5min\)":\{)(.*)(\}\})$'
    head, bars, end = (F.regexp_extract("value", parts, k) for k in (1, 2, 3))
    spoilt = F.regexp_replace(bars, "2. high", "2. none")
    documents = build_payloads(read_bars(spark, sf_dir))
    repeated = documents.select(F.concat(head, spoilt, F.lit(","), bars, end).alias("value"))
    flat = unpivot_payloads(repeated)
    return flat.select("symbol", *PRICES, F.col("date").cast("timestamp_ntz").alias("timestamp"))


def payload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed with other JSON and with pages; each bar or rejected text is a row."""
    documents = build_payloads(read_bars(spark, sf_dir))
    other = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("props").alias("value"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").alias("value"))
    flat = unpivot_payloads(documents.unionByName(other).unionByName(pages))
    return flat.groupBy("fault").agg(F.count(F.lit(1)).alias("rows"))


# --- streams ------------------------------------------------------------------------------------


def _config(spark: SparkSession, name: str, **settings) -> PipelineConfig:
    """A bounded run in new folders, with as many state partitions as the cluster has slots."""
    root = scratch_dir(spark, name)
    return PipelineConfig(
        checkpoint=f"{root}/checkpoint",
        tables=f"{root}/tables",
        trigger=None,
        state_partitions=max(8, spark.sparkContext.defaultParallelism),
        **settings,
    )


def _wait(*queries) -> None:
    supervise(queries, bounded=True, poll_seconds=0.2)


def stream_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream is processed, then again by a query that has lost its checkpoint."""
    config = _config(spark, "agg", width="1 hour")
    _wait(start_aggregates(spark, stream_ticks(spark, sf_dir), config))
    again = PipelineConfig(**{**vars(config), "checkpoint": f"{config.checkpoint}-2"})
    _wait(start_aggregates(spark, stream_ticks(spark, sf_dir), again))
    return _rounded(read_aggregates(spark, config.aggregates))


def final_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window appears once, when the watermark has passed its end."""
    config = _config(spark, "final", width="1 hour", output_mode="append")
    _wait(start_aggregates(spark, stream_ticks(spark, sf_dir), config))
    return _rounded(read_aggregates(spark, config.aggregates))


def stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(spark, "raw")
    _wait(start_raw(spark, stream_ticks(spark, sf_dir), config))
    return _plain(read_stocks(spark, config.stocks))


def _in_runs(stocks: DataFrame, runs: int) -> list[DataFrame]:
    """The table cut at equal distances in time; rows without one are in the first run."""
    first, last = stocks.agg(F.min("timestamp"), F.max("timestamp")).first()
    cuts = [first + (last - first) * i / runs for i in range(runs)]
    cuts.append(last + timedelta(microseconds=1))
    time = F.col("timestamp")
    kind = stocks.schema["timestamp"].dataType
    slices = [
        (time >= F.lit(str(a)).cast(kind)) & (time < F.lit(str(b)).cast(kind))
        for a, b in zip(cuts, cuts[1:])
    ]
    slices[0] = slices[0] | time.isNull()
    return [stocks.where(part) for part in slices]


def _pipeline(spark: SparkSession, sf_dir: str, name: str, fold: bool = False) -> PipelineConfig:
    """Scheduled runs: each publishes messages, then the pipeline goes on from its checkpoint."""
    config = _config(spark, name)
    landing = f"{config.tables}/landing"
    for number, rows in enumerate(_in_runs(read_ticks(spark, sf_dir), 3)):
        publish_files(to_messages(rows), landing, number)
        run_available(spark, read_files(spark, f"{landing}/run=*"), config)
        if fold:
            for table, path in ((STOCKS_TABLE, config.stocks), (AGGREGATES_TABLE, config.aggregates)):
                table.fold(spark, path)
                table.merge(spark, path)
                table.expire(spark, path)
    return config


def _summed(spark: SparkSession, sf_dir: str, name: str) -> PipelineConfig:
    """Bars in four runs. The first two are folded and merged, the third is folded, the last is in the log."""
    config = _config(spark, name)
    landing = f"{config.tables}/landing"
    for number, rows in enumerate(_in_runs(read_bars(spark, sf_dir), 4)):
        publish_files(to_messages(rows), landing, number)
        parsed = parse_messages(read_files(spark, f"{landing}/run=*"))
        _wait(start_raw(spark, parsed, config))
        if number < 3:
            STOCKS_TABLE.fold(spark, config.stocks)
        if number < 2:
            STOCKS_TABLE.merge(spark, config.stocks)
    return config


def total_from_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.total_from_summary(spark, _summed(spark, sf_dir, "total").stocks)


def latest_from_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(dashboard.latest_from_summary(spark, _summed(spark, sf_dir, "latest").stocks))


def spread_from_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that begins and ends within a day."""
    return dashboard.spreads_from_summary(spark, _summed(spark, sf_dir, "spread").stocks, *PART)


def pipeline_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(read_stocks(spark, _pipeline(spark, sf_dir, "stocks").stocks))


def pipeline_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(read_aggregates(spark, _pipeline(spark, sf_dir, "windows").aggregates))


def pipeline_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are folded, merged and cleaned after every run. Minutes come from one, hours from the other."""
    config = _pipeline(spark, sf_dir, "folded", fold=True)
    minutes = read_aggregates(spark, config.aggregates)
    hours = window_aggregate(read_stocks(spark, config.stocks), "1 hour", "timestamp")
    return _rounded(minutes.unionAll(hours))


def _resent(spark: SparkSession, sf_dir: str, name: str, dedup: bool) -> DataFrame:
    config = _config(spark, name, width="1 hour", dedup=dedup)
    landing = f"{config.tables}/landing"
    for number in range(2):
        publish_files(to_messages(read_ticks(spark, sf_dir)), landing, number)
        parsed = parse_messages(read_files(spark, f"{landing}/run=*"))
        _wait(start_aggregates(spark, parsed, config))
    return _rounded(read_aggregates(spark, config.aggregates))


def late_resend_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages are sent twice. Those of closed windows are late and dropped; in a window
    that is still open they count again."""
    return _resent(spark, sf_dir, "late", dedup=False)


def dedup_resend_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages are sent twice, and each bar counts once."""
    return _resent(spark, sf_dir, "dedup", dedup=True)


def folded_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol's rows from merged and folded files, which are sorted by symbol, and from the log."""
    stocks = read_stocks(spark, _summed(spark, sf_dir, "symbol").stocks)
    return _plain(keep_symbols(stocks, ("view",)))


def _stated(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    """The statement that a database gets for a panel, answered by Spark."""
    view = f"bars_{uuid.uuid4().hex}"
    read_bars(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(statements.statement(panel, view, *PART, quote="`", double="double"))


def statement_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir, "spread")


def statement_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir, "series")


def late_rows_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages are sent twice to hourly windows: the rows that Spark has dropped as late."""
    config = _config(spark, "late-rows", width="1 hour")
    landing = f"{config.tables}/landing"
    for number in range(2):
        publish_files(to_messages(read_ticks(spark, sf_dir)), landing, number)
        parsed = parse_messages(read_files(spark, f"{landing}/run=*"))
        _wait(start_aggregates(spark, parsed, config))
    sent = read_files(spark, f"{landing}/run=*", stream=False)
    placed = with_batches(spark, sent, f"{config.checkpoint}/aggregates")
    rows = accepted(parse_messages(placed, carry=("batch",)))
    late = late_rows(rows, config.width, config.watermark)
    return _plain(late.select("symbol", *PRICES, F.col("event_time").alias("timestamp"), "judged_by"))


def open_windows_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the watermark has not passed, read from the state that the run has left."""
    config = _config(spark, "open", width="1 hour")
    _wait(start_aggregates(spark, stream_ticks(spark, sf_dir), config))
    return _plain(open_windows(spark, f"{config.checkpoint}/aggregates"))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of one query, the second with spoilt messages: what each batch has written."""
    config = _config(spark, "counts")
    landing = f"{config.tables}/landing"
    stocks = read_ticks(spark, sf_dir)
    early = F.coalesce(F.col("symbol") < "f", F.lit(False))
    parts = (to_messages(stocks.where(early)), spoilt_messages(spark, sf_dir), to_messages(stocks.where(~early)))
    for number, messages in enumerate(parts):
        publish_files(messages.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")), landing, number)
        _wait(start_raw(spark, parse_messages(read_files(spark, f"{landing}/run=*")), config))
        if number == 1:
            STOCKS_TABLE.fold(spark, config.stocks)
    return STOCKS_TABLE.batch_counts(spark, config.stocks).drop("epoch")


def empty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over files without messages is a batch without rows; it adds none to the table and ends nothing."""
    config = _config(spark, "empty")
    landing = f"{config.tables}/landing"
    stocks = read_ticks(spark, sf_dir)
    for number, rows in enumerate((stocks.limit(0), stocks, stocks.limit(0))):
        publish_files(to_messages(rows), landing, number)
        _wait(start_raw(spark, parse_messages(read_files(spark, f"{landing}/run=*")), config))
        STOCKS_TABLE.fold(spark, config.stocks)
    return _plain(read_stocks(spark, config.stocks))


def lost_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message folder per symbol is listed by a query; that of errors is gone when one looks again."""
    config = _config(spark, "lost")
    landing = f"{config.tables}/landing"
    stocks = read_ticks(spark, sf_dir).where(F.col("symbol").isin(*EVENT_SYMBOLS))
    for symbol in EVENT_SYMBOLS:
        publish_files(to_messages(stocks.where(F.col("symbol") == symbol)), landing, symbol)
    _wait(start_raw(spark, parse_messages(read_files(spark, f"{landing}/run=*")), config))
    fs.delete(spark, f"{landing}/run=error")
    lost = lost_files(spark, f"{config.checkpoint}/raw", f"{landing}/run=*")
    return lost.select(F.regexp_extract("path", "/run=([^/]+)/", 1).alias("symbol")).distinct()


def timed_agg_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, a batch each, under a timed trigger; the run ends when they are processed."""
    config = PipelineConfig(**{**vars(_config(spark, "timed", width="1 hour")), "trigger": "100 milliseconds"})
    landing = f"{config.tables}/landing"
    for number, rows in enumerate(_in_runs(read_ticks(spark, sf_dir), 3)):
        publish_files(to_messages(rows).coalesce(1), landing, number)
    messages = read_files(spark, f"{landing}/run=*", max_files_per_trigger=1)
    run_caught_up([start_aggregates(spark, parse_messages(messages), config)])
    return _rounded(read_aggregates(spark, config.aggregates))


def ingest_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second set of documents has all bars again and new ones; each is published once."""
    root = scratch_dir(spark, "ingest-resent")
    bars = read_bars(spark, sf_dir)
    for number, part in enumerate((bars.where(F.col("symbol") < "f"), bars)):
        build_payloads(part).write.text(f"{root}/landing/set={number}")
        query = ingest_documents(
            spark,
            read_files(spark, f"{root}/landing/set=*"),
            lambda rows, run: publish_files(rows, f"{root}/messages", run),
            f"{root}/checkpoint",
            f"{root}/quarantine",
            ledger=f"{root}/ledger",
        )
        _wait(query)
    sent = read_files(spark, f"{root}/messages/run=*", stream=False)
    got = accepted(parse_messages(sent)).withColumnRenamed("event_time", "timestamp")
    return _plain(got.select("symbol", *PRICES, "timestamp"))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that arrive as messages, found again in the quarantine of the raw table."""
    config = _config(spark, "quarantine")
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    pages = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages*.parquet")
    _wait(start_raw(spark, parse_messages(pages, "html"), config))
    kept = read_quarantine(spark, config.stocks)
    return kept.select("fault", F.col("raw_value").cast("string").alias("html"))


def pipeline_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checkpoints write into one table, which is folded after each batch.

    The first feed goes on after the second one, whose epoch is higher, was folded.
    """
    feeds = [_config(spark, f"feed-{side}") for side in "ab"]
    tables = feeds[0].tables
    feeds = [PipelineConfig(**{**vars(f), "tables": tables}) for f in feeds]
    for number, rows in enumerate(_in_runs(read_ticks(spark, sf_dir), 4)):
        config = feeds[number % 2]
        landing = f"{tables}/landing-{number % 2}"
        publish_files(to_messages(rows), landing, number)
        _wait(start_raw(spark, parse_messages(read_files(spark, f"{landing}/run=*")), config))
        STOCKS_TABLE.fold(spark, config.stocks)
        STOCKS_TABLE.expire(spark, config.stocks)
    return _plain(read_stocks(spark, feeds[0].stocks))


def ingest_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ingests with their own checkpoints and quarantines send into one message folder."""
    root = scratch_dir(spark, "ingest-two")
    bars = read_bars(spark, sf_dir)
    messages = f"{root}/messages"
    early = F.coalesce(F.col("symbol") < "f", F.lit(False))
    for number, part in enumerate((bars.where(early), bars.where(~early))):
        build_payloads(part).write.text(f"{root}/landing-{number}")
        query = ingest_documents(
            spark,
            read_files(spark, f"{root}/landing-{number}"),
            lambda rows, run: publish_files(rows, messages, run),
            f"{root}/checkpoint-{number}",
            f"{root}/quarantine-{number}",
        )
        _wait(query)
    sent = read_files(spark, f"{messages}/run=*", stream=False)
    got = accepted(parse_messages(sent)).withColumnRenamed("event_time", "timestamp")
    return _plain(got.select("symbol", *PRICES, "timestamp"))


def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed documents to messages in a bounded run; the messages parse back to the bars."""
    root = scratch_dir(spark, "ingest")
    build_payloads(read_bars(spark, sf_dir)).write.text(f"{root}/landing")
    documents = read_files(spark, f"{root}/landing")
    messages = f"{root}/messages"
    _wait(
        ingest_documents(
            spark,
            documents,
            lambda rows, run: publish_files(rows, messages, run),
            f"{root}/checkpoint",
            f"{root}/quarantine",
        )
    )
    sent = read_files(spark, f"{messages}/run=*", stream=False)
    bars = accepted(parse_messages(sent)).withColumnRenamed("event_time", "timestamp")
    return _plain(bars.select("symbol", *PRICES, "timestamp"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        latest_quotes,
        latest_quotes_bars,
        total_records,
        close_series,
        close_series_7d,
        close_wide,
        close_wide_1h,
        avg_spread,
        avg_spread_7d,
        last_known_close,
        symbol_filter,
        symbol_listed,
        ohlc_bars,
        agg_1m,
        agg_1h,
        resent_agg_1h,
        dedup_agg_1h,
        agg_1m_bars,
        agg_lines_1d,
        wire_roundtrip,
        quarantine_counts,
        loose_stocks,
        loose_agg_1h,
        foreign_messages,
        payload_unpivot,
        payload_repeated_keys,
        payload_faults,
        stream_agg_1h,
        final_agg_1h,
        stream_raw,
        pipeline_stocks,
        pipeline_aggregates,
        pipeline_folded,
        late_resend_agg_1h,
        dedup_resend_agg_1h,
        stream_quarantine,
        ingest_run,
        ingest_two_runs,
        pipeline_two_feeds,
        late_rows_resend,
        total_from_summary,
        latest_from_summary,
        spread_from_summary,
        folded_symbol,
        statement_spread,
        statement_series,
        open_windows_1h,
        batch_counts,
        empty_batches,
        lost_runs,
        timed_agg_1h,
        ingest_resent,
    )
}


def in_utc(query: Query) -> Query:
    """The given tables hold zone-less times; both ways of reading them agree in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run
