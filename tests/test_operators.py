import math
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from helpers import plan, rows
from tickloom.operators import (
    average_spread,
    drop_resent,
    keep_listed,
    keep_symbols,
    last_not_null,
    latest_per_key,
    long_series,
    newest_version,
    ohlc_bars,
    wide_series,
    window_aggregate,
)
from tickloom.plans import dashboard

STOCKS = "symbol string, open double, high double, low double, close double, timestamp timestamp"
T0 = datetime(2024, 1, 1, 9, 30)


def stocks(spark, *records):
    return spark.createDataFrame(list(records), STOCKS)


def tick(symbol, seconds, close, high=None, low=None):
    time = None if seconds is None else T0 + timedelta(seconds=seconds)
    return (symbol, close, close if high is None else high, close if low is None else low, close, time)


def test_window_edges_and_nulls(spark):
    df = stocks(
        spark,
        tick("A", 0, 1.0),
        tick("A", 59.999999, 3.0),
        tick("A", 60, 5.0),
        ("A", None, None, None, None, T0),
        tick("A", None, 9.0),
        tick(None, 0, 7.0),
    )
    got = rows(window_aggregate(df, "1 minute", "timestamp"))
    minute = timedelta(minutes=1)
    assert got == sorted(
        [
            (T0, T0 + minute, "A", 2.0, 1.0, 3.0, 2),
            (T0 + minute, T0 + 2 * minute, "A", 5.0, 5.0, 5.0, 1),
            (T0, T0 + minute, None, 7.0, 7.0, 7.0, 1),
        ],
        key=repr,
    )


def test_windows_before_the_epoch(spark):
    df = spark.sql("SELECT 'A' symbol, 1D low, 1D high, 1D close, timestamp'1969-12-31 23:59:59.5' t")
    row = window_aggregate(df, "1 hour", "t").first()
    assert (row.window_start, row.window_end) == (
        datetime(1969, 12, 31, 23),
        datetime(1970, 1, 1),
    )


def test_hot_symbol_against_brute_force(spark):
    """A third of all rows under one symbol, most of them in one window."""
    records = [tick("HOT", (i % 50) / 10, float(i % 7)) for i in range(1000)]
    records += [tick(f"S{i % 40}", i, i / 8, i / 4, i / 16) for i in range(2000)]
    want = defaultdict(list)
    for symbol, _, high, low, close, time in records:
        want[(time.replace(second=0, microsecond=0), symbol)].append((low, high, close))
    df = stocks(spark, *records).repartition(16)
    got = window_aggregate(df, "1 minute", "timestamp").collect()
    assert len(got) == len(want)
    for r in got:
        group = want[(r.window_start, r.symbol)]
        assert r.trade_count == len(group)
        assert r.min_low == min(g[0] for g in group) and r.max_high == max(g[1] for g in group)
        assert math.isclose(r.avg_close, sum(g[2] for g in group) / len(group))
    newest = {}
    for r in records:
        newest[r[0]] = max(newest.get(r[0], r[5]), r[5])
    latest = latest_per_key(df, ["timestamp"]).collect()
    assert {r.symbol: r.timestamp for r in latest} == newest


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ABC"),
            st.one_of(st.none(), st.integers(0, 5)),
            st.one_of(st.none(), st.integers(0, 3)),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_latest_is_one_whole_newest_row(spark, records):
    df = stocks(spark, *(tick(s, t, None if c is None else float(c)) for s, t, c in records))
    for r in latest_per_key(df, ["close", "high", "timestamp"]).collect():
        mine = [(t, c) for s, t, c in records if s == r.symbol]
        best = None if any(t is None for t, _ in mine) else max(t for t, _ in mine)
        assert r.timestamp == (None if best is None else T0 + timedelta(seconds=best))
        assert r.close in [None if c is None else float(c) for t, c in mine if t == best]
        assert r.high == r.close
    known = {r.symbol: r.close for r in last_not_null(df, "close").collect()}
    for symbol in {s for s, _, c in records if c is not None}:
        mine = [(math.inf if t is None else t, c) for s, t, c in records if s == symbol and c is not None]
        assert known.pop(symbol) in [float(c) for t, c in mine if t == max(mine)[0]]
    assert not known


def test_latest_quotes_titles_and_order(spark):
    df = stocks(spark, tick("B", 1, 1.0), tick("A", 1, 1.0), ("A", 1.0, 4.0, 0.5, 2.0, T0 + timedelta(9)))
    got = dashboard.latest_quotes(df)
    assert got.columns == [
        "symbol", "Latest Close", "Day High", "Day Low", "Day Open", "Last Updated",
    ]
    assert [tuple(r)[:5] for r in got.collect()] == [("A", 2.0, 4.0, 0.5, 1.0), ("B", 1.0, 1.0, 1.0, 1.0)]


def test_newest_version_takes_a_whole_row(spark):
    df = spark.createDataFrame(
        [(1, "a", 5.0, 3), (1, None, 2.0, 7), (2, "c", None, 1)],
        "k int, x string, y double, version bigint",
    )
    assert rows(newest_version(df, ["k"])) == [(1, None, 2.0, 7), (2, "c", None, 1)]


def test_range_includes_both_ends(spark):
    df = stocks(spark, *(tick("A", s, float(s)) for s in (3, 0, 1, 2)), tick("A", None, 9.0))
    start, end = T0 + timedelta(seconds=1), "2024-01-01 09:30:02"
    got = [tuple(r) for r in long_series(df, start, end).collect()]
    assert got == [(T0 + timedelta(seconds=s), "A", float(s)) for s in (1, 2)]
    assert long_series(df).count() == 5


def test_series_keeps_every_copy_in_order(spark):
    df = stocks(spark, *[tick("A", 1, 1.0)] * 500, *(tick("B", i % 3, float(i)) for i in range(500)))
    got = [tuple(r) for r in long_series(df.repartition(7)).collect()]
    assert len(got) == 1000 and got == sorted(got)


def test_wide_takes_the_last_value_per_bucket(spark):
    df = stocks(spark, tick("A", 1, 1.0), tick("A", 50, 2.0), tick("B", 3, 7.0), tick("A", 70, 3.0))
    got = [tuple(r) for r in wide_series(df, ["A", "B", "C"], bucket="1 minute").collect()]
    assert got == [(T0, 2.0, 7.0, None), (T0 + timedelta(minutes=1), 3.0, None, None)]
    assert wide_series(df, ["A", "B"]).count() == 4


@pytest.mark.parametrize(
    "spreads, rounded",
    [((0.00005,), 0.0001), ((-0.00005,), -0.0001), ((0.1, 0.2), 0.15), ((0.00004,), 0.0)],
)
def test_spread_rounds_half_away_from_zero(spark, spreads, rounded):
    df = stocks(spark, *(("A", 0.0, s, 0.0, 0.0, T0) for s in spreads))
    assert average_spread(df).first()[1] == rounded


def test_spread_is_ranked(spark):
    df = stocks(spark, tick("B", 0, 1.0, 3.0, 1.0), tick("C", 0, 1.0, 9.0, 1.0), tick("A", 0, 1.0, 3.0, 1.0))
    assert [r[0] for r in average_spread(df).collect()] == ["C", "A", "B"]


def test_bars(spark):
    df = stocks(spark, *(tick("A", s, c) for s, c in ((299, 4.0), (0, 3.0), (10, 9.0), (20, 1.0), (300, 8.0))))
    assert rows(ohlc_bars(df)) == [
        ("A", 3.0, 9.0, 1.0, 4.0, T0),
        ("A", 8.0, 8.0, 8.0, 8.0, T0 + timedelta(minutes=5)),
    ]


def test_resent_rows_count_once(spark):
    df = stocks(spark, *[tick("A", 1, 1.0)] * 9, tick("A", 2, 1.0), tick("B", 1, 1.0))
    assert drop_resent(df, ["symbol", "timestamp"]).count() == 3


def test_symbol_lists(spark):
    df = stocks(spark, tick("AAPL", 0, 1.0), tick("X", 0, 1.0), tick(None, 0, 1.0))
    assert [r.symbol for r in keep_symbols(df).collect()] == ["AAPL"]
    listed = spark.createDataFrame([("X",), ("X",), (None,)], "symbol string")
    assert [r.symbol for r in keep_listed(df, listed).collect()] == ["X"]
    assert "Broadcast" in plan(keep_listed(df, listed))
    with_shuffle = keep_listed(df, listed, broadcast_bytes=0)
    assert [r.symbol for r in with_shuffle.collect()] == ["X"]
    assert keep_listed(df, listed.limit(0)).count() == 0
