import os
from datetime import date, datetime

import pytest

from helpers import plan, rows
from tickloom.plans import dashboard
from tickloom.session import session_conf
from tickloom.sinks import AGGREGATES_TABLE, STOCKS_TABLE, open_epoch, version_of
from tickloom.sinks.lake import read_aggregates, read_quarantine, read_stocks

WINDOW = (
    "window_start timestamp, window_end timestamp, symbol string, avg_close double, "
    "min_low double, max_high double, trade_count bigint"
)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def windows(spark, *records):
    """(minute, symbol, count) to aggregate rows."""
    full = [
        (datetime(2024, 1, 1 + m // 1440, m // 60 % 24, m % 60), datetime(2025, 1, 1), s, float(n), 0.0, 1.0, n)
        for m, s, n in records
    ]
    return spark.createDataFrame(full, WINDOW)


def state(spark, path, **bounds):
    got = read_aggregates(spark, path, **bounds).collect()
    day0 = datetime(2024, 1, 1)
    return sorted(
        (int((r.window_start - day0).total_seconds() // 60), r.symbol, r.trade_count) for r in got
    )


def raw(spark, *records):
    schema = STOCKS_TABLE.columns
    full = [(s, 1.0, 1.0, 1.0, 1.0, t, bytearray(b"x") if f != "ok" else None, f) for s, t, f in records]
    return spark.createDataFrame(full, schema)


def test_epoch_belongs_to_checkpoint(spark, tmp_path, path):
    first, second = str(tmp_path / "c1"), str(tmp_path / "c2")
    assert open_epoch(spark, first, path) == 0
    assert open_epoch(spark, first, path) == 0
    assert open_epoch(spark, second, path) == 1
    assert open_epoch(spark, first, path) == 0
    assert version_of(1, 0) > version_of(0, 10**9)


def test_empty_table(spark, path):
    assert read_stocks(spark, path).count() == 0
    assert read_aggregates(spark, path).count() == 0
    assert AGGREGATES_TABLE.fold(spark, path) is None


def test_batch_written_again_replaces_itself(spark, path):
    df = raw(spark, ("A", datetime(2024, 1, 1), "ok"), ("A", datetime(2024, 1, 1), "ok"))
    STOCKS_TABLE.write_batch(df, path, 3)
    STOCKS_TABLE.write_batch(df, path, 3)
    assert read_stocks(spark, path).count() == 2
    with session_conf(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        STOCKS_TABLE.write_batch(df, path, 3)
    assert read_stocks(spark, path).count() == 2


def test_newest_version_wins_across_batches_and_epochs(spark, path):
    write = lambda v, *r: AGGREGATES_TABLE.write_batch(windows(spark, *r), path, v, files=2)
    write(version_of(0, 9), (0, "A", 1), (1, "A", 1), (1, "B", 4))
    write(version_of(0, 10), (0, "A", 2))
    write(version_of(1, 0), (1, "A", 7))
    assert state(spark, path) == [(0, "A", 2), (1, "A", 7), (1, "B", 4)]


def test_unfinished_batch_is_not_read(spark, path):
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 1)), path, 0)
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 2), (1, "A", 2)), path, 1)
    os.remove(f"{path}/log/version=1/_SUCCESS")
    assert state(spark, path) == [(0, "A", 1)]
    assert AGGREGATES_TABLE.fold(spark, path) == 0


def test_fold_keeps_the_state(spark, path):
    batches = [
        [(0, "A", 1), (2000, "A", 1)],
        [(0, "A", 2), (0, "B", 1)],
        [(0, "A", 3), (2000, "B", 5)],
        [],
        [(2000, "A", 9)],
    ]
    want = {}
    for version, batch in enumerate(batches):
        AGGREGATES_TABLE.write_batch(windows(spark, *batch), path, version)
        want.update({r[:2]: r for r in batch})
        if version in (1, 3):
            assert AGGREGATES_TABLE.fold(spark, path) == version
        assert state(spark, path) == sorted(want.values())
    assert AGGREGATES_TABLE.expire(spark, path) == 2
    assert state(spark, path) == sorted(want.values())
    # A batch that had been folded and is then written again does not undo newer ones.
    AGGREGATES_TABLE.write_batch(windows(spark, *batches[1]), path, 1)
    assert state(spark, path) == sorted(want.values())


def test_stopped_fold_is_done_again(spark, path):
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 1)), path, 0)
    AGGREGATES_TABLE.fold(spark, path)
    os.remove(f"{path}/folded/upto=0/_SUCCESS")
    assert state(spark, path) == [(0, "A", 1)]
    assert AGGREGATES_TABLE.fold(spark, path) == 0
    assert state(spark, path) == [(0, "A", 1)]


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("zone", ["UTC", "Pacific/Auckland", "America/Los_Angeles"])
def test_ranges_hold_in_any_zone(spark, path, fold, zone):
    minutes = list(range(0, 4320, 240))
    AGGREGATES_TABLE.write_batch(windows(spark, *((m, "A", 1) for m in minutes)), path, 0)
    if fold:
        AGGREGATES_TABLE.fold(spark, path)
    with session_conf(spark, spark__sql__session__timeZone=zone):
        for low, high in ((0, 4320), (240, 1440), (1441, 2879), (1440, 1440)):
            bound = [f"{date(2024, 1, 1 + m // 1440)}T{m // 60 % 24:02}:{m % 60:02}:00Z" for m in (low, high)]
            got = read_aggregates(spark, path, *bound).count()
            assert got == sum(low <= m <= high for m in minutes)


def test_range_skips_folders_and_row_groups(spark, path):
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 1), (2000, "A", 1)), path, 0)
    AGGREGATES_TABLE.fold(spark, path)
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 2)), path, 1)
    text = plan(read_aggregates(spark, path, "2024-01-01", "2024-01-01 12:00:00"))
    assert "PartitionFilters: [isnotnull(window_date" in text
    assert text.count("GreaterThanOrEqual(window_start") == 2
    assert "SortAggregate" not in text


def test_days_up_to_now_skip_folders(spark, path):
    AGGREGATES_TABLE.write_batch(windows(spark, (0, "A", 1)), path, 0)
    AGGREGATES_TABLE.fold(spark, path)
    df = read_aggregates(spark, path, *dashboard.last_days(7))
    assert df.count() == 0
    assert "window_date" in plan(df).split("PartitionFilters: ")[1].split("]")[0]


@pytest.mark.parametrize("fold", [False, True])
def test_quarantine_beside_the_rows(spark, path, fold):
    t = datetime(2024, 1, 1)
    STOCKS_TABLE.write_batch(
        raw(spark, ("A", t, "ok"), ("B", None, "bad_time"), (None, None, "malformed")), path, 0
    )
    if fold:
        STOCKS_TABLE.fold(spark, path)
    assert rows(read_stocks(spark, path)) == [("A", 1.0, 1.0, 1.0, 1.0, t)]
    assert read_stocks(spark, path, keep_malformed=True).count() == 3
    kept = {(r.fault, bytes(r.raw_value), r.symbol) for r in read_quarantine(spark, path).collect()}
    assert kept == {("bad_time", b"x", "B"), ("malformed", b"x", None)}
