"""Cases that clean tables do not show: replays across epochs, two ingests, odd zones and values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.operators.parse import parse_messages
from tickloom.plans import dashboard
from tickloom.session import scratch_dir, session_conf
from tickloom.sinks import AGGREGATES_TABLE, STOCKS_TABLE, version_of
from tickloom.sinks.lake import read_stocks
from tickloom.sinks.messages import publish_files
from tickloom.sources.messages import read_files
from tickloom.streaming.ingest import ingest_documents

from test_lake import raw, state, windows

NINE = datetime(2024, 1, 1, 9)


def test_batch_of_a_lower_epoch_after_a_fold(spark, tmp_path):
    path = str(tmp_path / "table")

    def write(epoch, batch, minute):
        AGGREGATES_TABLE.write_batch(windows(spark, (minute, "A", 1)).withColumn("version", F.lit(0)), path, version_of(epoch, batch))

    write(0, 0, 1)
    write(1, 0, 2)
    assert AGGREGATES_TABLE.fold(spark, path) == version_of(1, 0)
    write(0, 1, 3)
    everything = [(1, "A", 1), (2, "A", 1), (3, "A", 1)]
    assert state(spark, path) == everything
    assert AGGREGATES_TABLE.fold(spark, path) == version_of(0, 1)
    AGGREGATES_TABLE.expire(spark, path)
    assert state(spark, path) == everything
    write(1, 1, 4)
    AGGREGATES_TABLE.fold(spark, path)
    AGGREGATES_TABLE.expire(spark, path)
    assert state(spark, path) == [*everything, (4, "A", 1)]


def test_raw_batch_of_a_lower_epoch_after_a_fold(spark, tmp_path):
    path = str(tmp_path / "table")
    for k, (epoch, batch) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)]):
        STOCKS_TABLE.write_batch(raw(spark, (f"S{k}", NINE, "ok")), path, version_of(epoch, batch))
        if k:
            STOCKS_TABLE.fold(spark, path)
            STOCKS_TABLE.expire(spark, path)
    assert sorted(r.symbol for r in read_stocks(spark, path).collect()) == ["S0", "S1", "S2", "S3"]


def test_two_ingests_share_a_message_folder(spark, tmp_path):
    out = str(tmp_path / "messages")
    for name in "AB":
        landing = tmp_path / f"in-{name}"
        landing.mkdir()
        body = '{"Meta Data": {"2. Symbol": "%s"}, "Time Series (5min)": {"2024-01-01 09:30:00": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "1"}}}' % name
        (landing / "doc.json").write_text(body)
        documents = read_files(spark, str(landing), whole_files=True)
        query = ingest_documents(
            spark, documents, lambda rows, run: publish_files(rows, out, run), str(tmp_path / f"cp-{name}"), str(tmp_path / f"bad-{name}")
        )
        query.awaitTermination()
    sent = [r.value for r in read_files(spark, f"{out}/run=*", stream=False).collect()]
    assert len(sent) == 2 and any('"A"' in m for m in sent) and any('"B"' in m for m in sent)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_missing_time_in_any_zone(spark, zone):
    with session_conf(spark, spark__sql__session__timeZone=zone):
        rows = spark.createDataFrame(
            [("A", 1.0, 1.0, 1.0, 1.0, NINE), ("A", 2.0, 2.0, 2.0, 2.0, None)],
            "symbol string, open double, high double, low double, close double, timestamp timestamp",
        )
        assert dashboard.latest_quotes(rows).count() == 1


def test_large_prices_do_not_end_the_spread(spark):
    rows = spark.createDataFrame(
        [("A", 1.0, 1e30, 1.0, 1.0, NINE), ("B", 1.0, 2.0, 1.0, 1.0, NINE)],
        "symbol string, open double, high double, low double, close double, timestamp timestamp",
    )
    assert dashboard.spreads(rows).count() == 2


def test_a_time_needs_a_full_date(spark):
    body = '{"symbol":"A","open":1.0,"high":1.0,"low":1.0,"close":1.0,"timestamp":"%s"}'
    texts = ["09:30", "2024", "2024-01-01 09:30:00", "2024-01-01T09:33:00Z"]
    frame = spark.createDataFrame([(body % t,) for t in texts], "value string")
    assert [r.fault for r in parse_messages(frame).collect()] == ["bad_time", "bad_time", "ok", "ok"]


def test_intermediate_tables_need_a_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(before)
