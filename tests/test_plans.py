"""Plans that have to hold at scale, checked on what Spark would run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from bench import STREAMS
from helpers import optimized, plan
from tickloom.operators import long_series
from tickloom.plans import catalogue, dashboard
from tickloom.plans.adapters import read_ticks
from tickloom.session import session_conf

BATCH = [
    name
    for name in catalogue.QUERIES
    if name not in STREAMS
]


@pytest.mark.parametrize("name", BATCH)
def test_no_sorting_aggregates_cross_joins_or_python(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    for bad in ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Window "):
        assert bad not in text
    assert optimized(catalogue.QUERIES[name](spark, sf_dir)).count("from_json(") <= 1


@pytest.mark.parametrize("name", ["agg_1m", "latest_quotes", "close_wide", "avg_spread"])
def test_rows_are_folded_before_the_shuffle(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "partial_" in text.split("Exchange hashpartitioning")[-1]


def test_range_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalogue.QUERIES["close_series"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "In(event_type" in plan(catalogue.QUERIES["symbol_filter"](spark, sf_dir))


def test_the_week_of_bars_bounds_the_scan_of_ticks(spark, sf_dir):
    text = plan(dashboard.week_of_bars(read_ticks(spark, sf_dir)))
    assert "PushedFilters: [GreaterThanOrEqual(ts,ScalarSubquery" in text


def test_count_reads_no_column(spark, sf_dir):
    assert "ReadSchema: struct<>" in plan(dashboard.total_records(read_ticks(spark, sf_dir)))


@pytest.mark.parametrize("name", ["close_wide", "close_wide_1h", "agg_1h", "ohlc_bars"])
def test_one_shuffle_by_key(spark, sf_dir, name):
    assert plan(catalogue.QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_a_run_of_equal_rows_is_cut(spark):
    """A third of the rows are copies of one; sorted, they must not lie in one partition."""
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'HOT', 'S') symbol",
        "if(id % 3 = 0, 1D, double(id)) close",
        "timestamp_micros(if(id % 3 = 0, 0, id)) timestamp",
    )
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        placed = long_series(rows).select("metric", F.spark_partition_id().alias("p")).collect()
    sizes = Counter(r.p for r in placed)
    assert sum(sizes.values()) == 30_000
    assert len({r.p for r in placed if r.metric == "HOT"}) > 1
    assert max(sizes.values()) < 30_000 / 4
