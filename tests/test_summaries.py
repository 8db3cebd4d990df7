"""Merged folds, summaries, lasting counts, late rows, open windows, lost files, the ledger and the panels' statements."""

import glob
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import land, message, plan, rows
from tickloom.operators import accepted, parse_messages
from tickloom.plans import dashboard, statements
from tickloom.sinks import AGGREGATES_TABLE, STOCKS_TABLE, fs, version_of
from tickloom.sinks.lake import read_aggregates, read_quarantine, read_stocks
from tickloom.sources import read_files
from tickloom.streaming import (
    PipelineConfig,
    late_rows,
    lost_files,
    open_windows,
    run_caught_up,
    start_aggregates,
    start_raw,
    supervise,
    with_batches,
)
from tickloom.streaming import progress
from tickloom.streaming.ingest import not_published
from test_lake import raw, state, windows

DAY = datetime(2024, 1, 1)


def priced(spark, *records):
    """(symbol, time, price, fault) to rows of the raw table; high - low is a tenth of the price."""
    full = [(s, p, p, None if p is None else p - p / 10, p, t, None, f) for s, t, p, f in records]
    return spark.createDataFrame(full, STOCKS_TABLE.columns)


def some(rng, n):
    out = []
    for _ in range(n):
        time = None if rng.random() < 0.05 else DAY + timedelta(minutes=rng.randrange(60 * 24 * 6))
        price = None if rng.random() < 0.1 else float(rng.randrange(1000))
        out.append((rng.choice("ABC"), time, price, "ok" if time and rng.random() < 0.9 else "bad_time"))
    return out


@pytest.mark.parametrize("expire", [False, True])
def test_merges_and_summaries_keep_the_rows(spark, tmp_path, expire):
    path, rng, held = f"file://{tmp_path}/t", random.Random(2), []
    for version in range(6):
        batch = some(rng, 60)
        # Two checkpoints write by turns.
        STOCKS_TABLE.write_batch(priced(spark, *batch), path, version_of(version % 2, version // 2))
        held += batch
        if version % 3 != 2:
            STOCKS_TABLE.fold(spark, path)
        if version in (1, 4):
            STOCKS_TABLE.merge(spark, path)
        if expire:
            STOCKS_TABLE.expire(spark, path)
        good = [(s, t, p) for s, t, p, f in held if f == "ok"]
        assert Counter((r.symbol, r.timestamp, r.close) for r in read_stocks(spark, path).collect()) == Counter(good)
        assert read_quarantine(spark, path).count() == len(held) - len(good)
        stocks = read_stocks(spark, path).cache()
        assert rows(dashboard.total_from_summary(spark, path)) == rows(dashboard.total_records(stocks))
        newest = {s: max(t for x, t, _ in good if x == s) for s in {s for s, _, _ in good}}
        latest = dashboard.latest_from_summary(spark, path).collect()
        assert {r.symbol: r["Last Updated"] for r in latest} == newest
        assert all((r.symbol, r["Last Updated"], r["Latest Close"]) in good for r in latest)
        spans = (("2024-01-01 07:00:00", "2024-01-05 13:30:00"), ("2024-01-02 01:00:00", "2024-01-02 23:00:00"), ("2024-01-02", "2024-01-04"))
        for span in spans if version > 3 else spans[:1]:
            assert rows(dashboard.spreads_from_summary(spark, path, *span)) == rows(dashboard.spreads(stocks, *span))
        stocks.unpersist()


def test_keyed_table_keeps_the_newest_through_merges(spark, tmp_path):
    path, want, rng = f"file://{tmp_path}/t", {}, random.Random(3)
    for version in range(7):
        batch = {(rng.randrange(6) * 720, rng.choice("AB")): rng.randrange(100) for _ in range(6)}
        AGGREGATES_TABLE.write_batch(windows(spark, *((m, s, n) for (m, s), n in batch.items())), path, version)
        want.update(batch)
        AGGREGATES_TABLE.fold(spark, path)
        if version % 2:
            AGGREGATES_TABLE.merge(spark, path)
            AGGREGATES_TABLE.expire(spark, path)
        assert state(spark, path) == sorted((m, s, n) for (m, s), n in want.items())


def folders_read(df):
    return {os.path.dirname(f) for f in df.inputFiles()}


def test_folders_read_do_not_grow_with_folds(spark, tmp_path):
    path, sizes = f"file://{tmp_path}/t", []
    for version in range(6):
        AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", version), (1500, "B", version)), path, version)
        AGGREGATES_TABLE.fold(spark, path)
        AGGREGATES_TABLE.merge(spark, path)
        AGGREGATES_TABLE.expire(spark, path)
        sizes.append(len(folders_read(read_aggregates(spark, path))))
        assert len(glob.glob(f"{tmp_path}/t/folded/upto=*")) <= 2
        assert len(glob.glob(f"{tmp_path}/t/merged/upto=*")) <= 2
    assert set(sizes) == {2}


def test_merge_writes_only_touched_dates(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for version, records in enumerate(([(0, "A", 1), (1500, "A", 1)], [(1500, "A", 2)])):
        AGGREGATES_TABLE.write_batch(windows(spark, *records), path, version)
        AGGREGATES_TABLE.fold(spark, path)
        AGGREGATES_TABLE.merge(spark, path)
    assert os.listdir(f"{tmp_path}/t/merged/upto=1").count("window_date=2024-01-01") == 0
    assert state(spark, path) == [(0, "A", 1), (1500, "A", 2)]


def test_stopped_merge_and_summary_are_done_without(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for version in range(2):
        STOCKS_TABLE.write_batch(priced(spark, ("A", DAY, 1.0 + version, "ok")), path, version)
        STOCKS_TABLE.fold(spark, path)
    STOCKS_TABLE.merge(spark, path)
    os.remove(f"{tmp_path}/t/merged/upto=1/_SUCCESS")
    os.remove(f"{tmp_path}/t/folded_summary/upto=1/_SUCCESS")
    assert read_stocks(spark, path).count() == 2
    assert rows(dashboard.total_from_summary(spark, path)) == [(2,)]
    assert STOCKS_TABLE.merge(spark, path) == 1
    assert read_stocks(spark, path).count() == 2


def test_plan_reads_summaries_and_tail_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for version in range(3):
        STOCKS_TABLE.write_batch(priced(spark, ("A", DAY, 1.0, "ok"), ("B", DAY, 2.0, "ok")), path, version)
        if version < 2:
            STOCKS_TABLE.fold(spark, path)
        if version == 0:
            STOCKS_TABLE.merge(spark, path)
    for panel in (dashboard.total_from_summary, dashboard.latest_from_summary):
        read = {f.removeprefix(f"{path}/").split("/")[0] for f in folders_read(panel(spark, path))}
        assert read == {"merged_summary", "folded_summary", "log"}
        assert "SortAggregate" not in plan(panel(spark, path))


def test_one_symbol_reads_few_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    records = [(f"S{k % 1000:04}", DAY + timedelta(seconds=k), float(k), "ok") for k in range(40_000)]
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        STOCKS_TABLE.write_batch(priced(spark, *records).repartition(4), path, 0)
        STOCKS_TABLE.fold(spark, path)
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    groups, hold, filtered = 0, 0, False
    for name in glob.glob(f"{tmp_path}/t/folded/**/*.parquet", recursive=True):
        about = pq.ParquetFile(name).metadata
        place = about.schema.names.index("symbol")
        for g in range(about.num_row_groups):
            stats = about.row_group(g).column(place).statistics
            groups += 1
            hold += stats.min <= "S0500" <= stats.max
    assert groups >= 10 and hold <= 2
    assert read_stocks(spark, path).where("symbol = 'S0500'").count() == 40


def test_counts_of_batches(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batch = priced(spark, ("A", DAY, 1.0, "ok"), ("B", None, 2.0, "bad_time"))
    for version in (0, 1, 1, version_of(1, 0)):
        STOCKS_TABLE.write_batch(batch, path, version)
    STOCKS_TABLE.write_batch(batch.limit(0), path, 2)
    want = [(0, 0, 2, 1), (0, 1, 2, 1), (0, 2, 0, 0), (1, 0, 2, 1)]
    assert rows(STOCKS_TABLE.batch_counts(spark, path)) == want
    STOCKS_TABLE.fold(spark, path)
    assert rows(STOCKS_TABLE.batch_counts(spark, path)) == want
    STOCKS_TABLE.write_batch(batch, path, 3)
    STOCKS_TABLE.fold(spark, path)
    STOCKS_TABLE.expire(spark, path)
    assert rows(STOCKS_TABLE.batch_counts(spark, path)) == sorted([*want, (0, 3, 2, 1)])
    assert STOCKS_TABLE.batch_counts(spark, f"{path}-none").count() == 0


def plain_late(batches, width, delay):
    """(batch, row) of late rows, by the rule of the previous batch."""
    late, held, newest = [], {}, []
    for number, times in batches:
        before = [t for n, ts in batches if n <= number - 2 for t in ts if t]
        mark = max(max(before) - delay, datetime(1970, 1, 1)) if before else datetime(1970, 1, 1)
        for t in times:
            if t and datetime(1970, 1, 1) + ((t - datetime(1970, 1, 1)) // width + 1) * width <= mark:
                late.append((number, t))
    return sorted(late)


def test_late_rows_by_the_rule(spark):
    rng = random.Random(7)
    batches, now = [], DAY
    for number in sorted(rng.sample(range(60), 30)):
        now += timedelta(minutes=rng.randrange(4))
        batches.append((number, [None if rng.random() < 0.05 else now - timedelta(seconds=rng.randrange(900)) for _ in range(20)]))
    frame = spark.createDataFrame([(n, t) for n, ts in batches for t in ts], "batch long, event_time timestamp")
    found = late_rows(frame.repartition(3), "1 minute", "2 minutes")
    expected = plain_late(batches, timedelta(minutes=1), timedelta(minutes=2))
    assert sorted((r.batch, r.event_time) for r in found.collect()) == expected and expected
    assert late_rows(frame.limit(0)).count() == 0


def test_late_rows_are_what_the_stream_dropped(spark, tmp_path):
    """One file per batch; aggregates and late rows together make up the input."""
    rng, now = random.Random(9), 0
    for number in range(9):
        now += rng.randrange(5)
        lines = [message(rng.choice("AB"), str(DAY + timedelta(minutes=now, seconds=-rng.randrange(600)))) for _ in range(12)]
        land(f"{tmp_path}/in", lines, f"f{number}.txt")
    config = PipelineConfig(f"file://{tmp_path}/c", f"file://{tmp_path}/t", trigger=None, state_partitions=2)
    stream = read_files(spark, f"{tmp_path}/in", max_files_per_trigger=1)
    supervise([start_aggregates(spark, parse_messages(stream), config)], bounded=True, poll_seconds=0.2)
    placed = with_batches(spark, read_files(spark, f"{tmp_path}/in", stream=False), f"{config.checkpoint}/aggregates")
    all_rows = accepted(parse_messages(placed, carry=("batch",)))
    late = late_rows(all_rows, config.width, config.watermark)
    assert all_rows.select("batch").distinct().count() >= 9
    counted = read_aggregates(spark, config.aggregates).agg(F.sum("trade_count")).first()[0]
    assert late.count() > 0
    assert counted + late.count() == all_rows.count() == 108
    # Windows still in the state are those that the last watermark has not passed.
    newest = max(r.event_time for r in all_rows.collect())
    held = {(r.window_start, r.symbol) for r in open_windows(spark, f"{config.checkpoint}/aggregates").collect()}
    known = {(r.window_start, r.window_end, r.symbol) for r in read_aggregates(spark, config.aggregates).collect()}
    assert held == {(a, s) for a, b, s in known if b > newest - timedelta(minutes=2)}


def test_lost_files(spark, tmp_path):
    for name in "ab":
        land(f"{tmp_path}/in/run={name}", [message("A", "2024-01-01 00:00:00")], "part.txt")
    config = PipelineConfig(f"file://{tmp_path}/c", f"file://{tmp_path}/t", trigger=None)
    stream = read_files(spark, f"{tmp_path}/in/run=*")
    supervise([start_raw(spark, parse_messages(stream), config)], bounded=True, poll_seconds=0.2)
    look = lambda: [r.path for r in lost_files(spark, f"{config.checkpoint}/raw", f"{tmp_path}/in/run=*").collect()]
    assert look() == []
    os.remove(f"{tmp_path}/in/run=a/part.txt")
    assert [p.endswith("/run=a/part.txt") for p in look()] == [True]


def test_file_lost_between_listing_and_reading(spark, tmp_path):
    """The batch goes on without it, and it is named afterwards."""
    for name in "ab":
        land(f"{tmp_path}/in/run={name}", [message(name, "2024-01-01 00:00:00")], "part.txt")
    config = PipelineConfig(f"file://{tmp_path}/c", f"file://{tmp_path}/t", trigger=None)
    parsed = parse_messages(read_files(spark, f"{tmp_path}/in/run=*"))
    write = STOCKS_TABLE.write_batch

    def late(batch, path, version, files=None):
        if os.path.exists(f"{tmp_path}/in/run=a/part.txt"):
            os.remove(f"{tmp_path}/in/run=a/part.txt")
        write(batch, path, version, files)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(STOCKS_TABLE), "write_batch", lambda self, *args: late(*args))
        supervise([start_raw(spark, parsed, config)], bounded=True, poll_seconds=0.2)
    assert [r.symbol for r in read_stocks(spark, config.stocks).collect()] == ["b"]
    lost = lost_files(spark, f"{config.checkpoint}/raw", f"{tmp_path}/in/run=*").collect()
    assert [r.path.split("/in/")[1] for r in lost] == ["run=a/part.txt"]


def test_timed_run_takes_each_file_as_a_batch(spark, tmp_path):
    for k in range(3):
        land(f"{tmp_path}/in", [message("A", f"2024-01-01 0{k}:00:00")], f"f{k}.txt")
    config = PipelineConfig(f"file://{tmp_path}/c", f"file://{tmp_path}/t", trigger="100 milliseconds")
    stream = read_files(spark, f"{tmp_path}/in", max_files_per_trigger=1)
    run_caught_up([start_raw(spark, parse_messages(stream), config)])
    assert rows(STOCKS_TABLE.batch_counts(spark, config.stocks)) == [(0, k, 1, 0) for k in range(3)]


def test_ledger(spark, tmp_path):
    schema = "symbol string, open double, high double, low double, close double, date string"
    bars = lambda *r: spark.createDataFrame([(s, p, p, p, p, f"2024-01-01 00:{m:02}:00") for s, m, p in r], schema)
    ledger = f"file://{tmp_path}/ledger"

    def publish(run, *records):
        new = not_published(spark, bars(*records), ledger, run)
        found = sorted((r.symbol, int(r.date[14:16]), r.close) for r in new.collect())
        new.select("symbol", "date", "content").write.mode("overwrite").parquet(f"{ledger}/run={run}")
        return found

    assert publish("a", ("A", 0, 1.0), ("A", 0, 1.0), ("B", 1, 2.0)) == [("A", 0, 1.0), ("B", 1, 2.0)]
    assert publish("b", ("A", 0, 1.0), ("B", 1, 3.0), ("A", 5, 1.0)) == [("A", 5, 1.0), ("B", 1, 3.0)]
    # A run that is repeated publishes the same again.
    assert publish("b", ("A", 0, 1.0), ("B", 1, 3.0), ("A", 5, 1.0)) == [("A", 5, 1.0), ("B", 1, 3.0)]
    assert publish("c") == []


@pytest.mark.parametrize("name", sorted(statements.PANELS))
def test_statements_equal_the_panels(spark, sf_dir, name):
    stocks = f"""CREATE VIEW stocks AS SELECT event_type AS symbol, value AS open, value + event_id % 7 AS high, value AS low,
        value AS close, CASE WHEN event_id <> 5 THEN ts END AS "timestamp" FROM '{sf_dir}/events.parquet'"""
    con = duckdb.connect()
    con.execute(stocks)
    span = ("2024-01-03 05:00:00", "2024-01-20 00:00:00")
    frame = spark.createDataFrame(con.execute("SELECT * FROM stocks").fetchall(), "symbol string, open double, high double, low double, close double, timestamp timestamp_ntz")
    expected = {
        "total": lambda: dashboard.total_records(frame),
        "latest": lambda: dashboard.latest_quotes(frame),
        "series": lambda: dashboard.close_prices(frame, *span),
        "spread": lambda: dashboard.spreads(frame, *span),
    }[name]()
    cursor = con.execute(statements.statement(name, start=span[0], end=span[1]))
    assert [d[0] for d in cursor.description] == expected.columns
    assert cursor.fetchall() == [tuple(r) for r in expected.collect()]
    # Spark reads it as well, with its own quotes.
    frame.createOrReplaceTempView("stocks")
    assert [tuple(r) for r in spark.sql(statements.statement(name, start=span[0], end=span[1], quote="`", double="double")).collect()] == [tuple(r) for r in expected.collect()]


def test_only_times_get_into_statements():
    with pytest.raises(ValueError):
        statements.statement("series", start="2024-01-01' OR 1=1 --")


def test_sums_of_old_runs_are_forgotten():
    report = {"numInputRows": 2, "batchId": 0}
    for run in range(progress.RUNS + 30):
        told = SimpleNamespace(json=json.dumps(report), runId=f"test-{run}", name="t", batchId=0)
        progress.BatchLog().onQueryProgress(SimpleNamespace(progress=told))
    assert len(progress._seen) == progress.RUNS
    last = SimpleNamespace(runId=f"test-{run}", recentProgress=[])
    assert progress.totals(last)["input_rows"] == 2
