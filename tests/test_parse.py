import json
from datetime import datetime

from helpers import message, optimized, rows
from pyspark.sql import functions as F
from tickloom.operators import accepted, parse_messages, quarantined, window_aggregate
from tickloom.sinks import to_messages

GOOD = message("A", "2024-01-01 09:30:00", 1.5)
# (message, fault, symbol, open)
DIRTY = [
    (GOOD, "ok", "A", 1.5),
    (message("A", "2024-01-01 09:30:00", open="1.0"), "malformed", "A", None),
    ('{"symbol":"A","open":1.0,"timestamp":"2024-01-01 09:30:00","x":1}', "missing_field", "A", 1.0),
    (message("A", "2024-01-01 09:30:00", 3), "ok", "A", 3.0),
    ("not json", "malformed", None, None),
    ("", "empty", None, None),
    (None, "empty", None, None),
    ("[]", "malformed", None, None),
    (message("A", "nope"), "bad_time", "A", 1.0),
    (message("A", 20240101), "bad_time", "A", 1.0),
    (GOOD[:-5], "malformed", None, None),
    (message("A", "2024-01-01T09:33:00Z"), "ok", "A", 1.0),
    (message(None, "2024-01-01 09:30:00"), "missing_field", None, 1.0),
    ("{}", "bad_time", None, None),
]


def feed(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return frame.select("i", F.col("value").cast("binary").alias("value")).orderBy("i").drop("i")


def test_dirty_messages(spark):
    parsed = parse_messages(feed(spark, [d[0] for d in DIRTY])).collect()
    assert [r.fault for r in parsed] == [d[1] for d in DIRTY]
    for row, (text, fault, symbol, opened) in zip(parsed, DIRTY):
        if not (fault == "malformed" and symbol is None):
            assert (row.symbol, row.open) == (symbol, opened)
        kept = None if fault == "ok" or text is None else text.encode()
        assert (None if row.raw_value is None else bytes(row.raw_value)) == kept


def test_split_is_whole(spark):
    parsed = parse_messages(feed(spark, [d[0] for d in DIRTY]))
    assert accepted(parsed).count() == 3
    assert quarantined(parsed).count() == len(DIRTY) - 3


def test_messages_are_parsed_once(spark):
    messages = spark.range(10).selectExpr("cast(id as string) as value")
    ok = accepted(parse_messages(messages))
    for df in (ok, window_aggregate(ok), quarantined(parse_messages(messages))):
        assert optimized(df).count("from_json(") == 1


def test_encode_keeps_values_and_names(spark):
    stocks = spark.sql(
        "SELECT 'A\"é' symbol, 0.1D open, 1e300D high, double('NaN') low, -0.0D close, "
        "timestamp'2024-01-01 09:30:00.000001' timestamp"
    )
    text = to_messages(stocks).first()[0]
    names = ["symbol", "open", "high", "low", "close", "timestamp"]
    assert list(json.loads(text)) == names
    back = accepted(parse_messages(to_messages(stocks))).drop("fault", "raw_value")
    assert repr(rows(back)) == repr(rows(stocks.select(*names)))


def test_topic_columns_do_not_clash(spark):
    """A topic has a time, key and offset of its own beside the value."""
    records = spark.createDataFrame(
        [(None, bytearray(GOOD.encode()), "t", 0, 7, datetime(2030, 1, 1))],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp",
    )
    assert parse_messages(records).first().event_time == datetime(2024, 1, 1, 9, 30)
