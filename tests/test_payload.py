import json

from tickloom.operators import accepted, build_payloads, unpivot_payloads

BAR = {"1. open": "1.0", "2. high": "4.0", "3. low": "0.5", "4. close": "2.0"}


def document(series, symbol="A"):
    return json.dumps({"Meta Data": {"2. Symbol": symbol}, "Time Series (5min)": series})


def unpivot(spark, *texts):
    rows = unpivot_payloads(spark.createDataFrame([(t,) for t in texts], "value string"))
    return [tuple(r) for r in rows.collect()]


def test_one_row_per_bar(spark):
    got = unpivot(spark, document({"t1": BAR, "t2": {**BAR, "4. close": " 3e0 ", "5. volume": "9"}}))
    assert got == [
        ("A", "t1", 1.0, 4.0, 0.5, 2.0, "ok", None),
        ("A", "t2", 1.0, 4.0, 0.5, 3.0, "ok", None),
    ]


def test_unusable_documents_give_a_row_each(spark):
    note, no_series = '{"Note": "limit"}', '{"Meta Data": {"2. Symbol": "A"}}'
    mistyped = document({"t1": BAR, "t2": "oops"})
    got = unpivot(spark, note, no_series, "", "[1]", None, mistyped)
    assert [(r[6], r[7]) for r in got] == [
        ("no_metadata", note),
        ("no_series", no_series),
        ("empty", ""),
        ("malformed", "[1]"),
        ("empty", None),
        ("malformed", mistyped),
    ]


def test_empty_series_has_no_bars(spark):
    assert unpivot(spark, document({})) == []


def test_bad_bars_leave_the_others(spark):
    bad = {**BAR, "2. high": "high"}
    short = {k: v for k, v in BAR.items() if k != "3. low"}
    suffix = {**BAR, "1. open": "1.5f"}
    got = unpivot(spark, document({"t1": bad, "t2": BAR, "t3": short, "t4": suffix}))
    assert [(r[1], r[6]) for r in got] == [
        ("t1", "bad_bar"),
        ("t2", "ok"),
        ("t3", "bad_bar"),
        ("t4", "bad_bar"),
    ]
    assert json.loads(got[0][7]) == bad and json.loads(got[2][7]) == short


def test_repeated_key_counts_last(spark):
    def one(close):
        return json.dumps({**BAR, "4. close": close})

    text = (
        '{"Meta Data": {"2. Symbol": "A"}, "Time Series (5min)": '
        f'{{"t1": {one("1")}, "t2": {one("2")}, "t1": {one("3")}, "t1": {one("4")}}}}}'
    )
    assert [(r[1], r[5]) for r in unpivot(spark, text)] == [("t2", 2.0), ("t1", 4.0)]


def test_repeated_key_in_a_bar_counts_last(spark):
    bar = '{"1. open":"1","2. high":"4","3. low":"0.5","4. close":"2","1. open":"9"}'
    text = '{"Meta Data": {"2. Symbol": "A"}, "Time Series (5min)": {"t1": %s, "t2": null}}' % bar
    got = unpivot(spark, text)
    assert [(r[1], r[2], r[6], r[7]) for r in got] == [
        ("t1", 9.0, "ok", None),
        ("t2", None, "bad_bar", "null"),
    ]


def test_long_document_with_a_repeat(spark):
    entries = ", ".join(f'"t{i}": {json.dumps(BAR)}' for i in [*range(100_000), 0])
    text = '{"Meta Data": {"2. Symbol": "A"}, "Time Series (5min)": {%s}}' % entries
    rows = unpivot_payloads(spark.createDataFrame([(text,)], "value string"))
    assert rows.select("date").distinct().count() == rows.count() == 100_000


def test_build_and_unpivot(spark):
    bars = spark.sql(
        "SELECT s symbol, double(id) open, id + 2D high, id - 1D low, id / 3D close, "
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 5 as int)) timestamp "
        "FROM range(600) CROSS JOIN VALUES ('A'), ('B') v(s)"
    )
    documents = build_payloads(bars)
    assert documents.count() == 2 * 3
    back = accepted(unpivot_payloads(documents)).selectExpr(
        "symbol", "open", "high", "low", "close", "cast(date as timestamp_ntz) timestamp"
    )
    assert back.exceptAll(bars).isEmpty() and bars.exceptAll(back).isEmpty()
