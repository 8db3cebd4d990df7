"""The statements run on the SQL engine of the oracle; no database is started for Spark."""

from datetime import datetime

import duckdb
import pytest

from helpers import land, message
from tickloom.schema import AGGREGATES, AGGREGATE_KEY, STOCKS
from tickloom.sinks import JdbcTarget, checkpoint_id, jdbc
from tickloom.sinks.lake import read_quarantine, read_stocks
from tickloom.sources import jdbc_options, read_files, tables
from tickloom.streaming import PipelineConfig, pipeline, run_available

TARGET = JdbcTarget("jdbc:postgresql://db/ticks", "u", "secret", connections=4)


@pytest.fixture
def db():
    con = duckdb.connect()
    con.execute(jdbc.ledger_ddl())
    con.execute(
        "CREATE TABLE agg (window_start TIMESTAMP, window_end TIMESTAMP, symbol VARCHAR, "
        "avg_close DOUBLE, min_low DOUBLE, max_high DOUBLE, trade_count BIGINT, "
        "PRIMARY KEY (window_start, symbol))"
    )
    con.execute("CREATE TABLE agg_stage AS SELECT * FROM agg WHERE false")
    return con


def stage(db, *records):
    db.execute("DELETE FROM agg_stage")
    for minute, symbol, n in records:
        db.execute(
            "INSERT INTO agg_stage VALUES (TIMESTAMP '2024-01-01' + to_minutes(?), "
            "TIMESTAMP '2025-01-01', ?, ?, 0, 1, ?)",
            [minute, symbol, n, n],
        )


def apply(db, statements):
    db.begin()
    for sql in statements:
        db.execute(sql)
    db.commit()


def state(db):
    return db.execute("SELECT symbol, trade_count, avg_close FROM agg ORDER BY ALL").fetchall()


def test_upsert_last_batch_wins_and_repeats_do_nothing(db):
    sql = lambda batch: jdbc.upsert_sql("agg", "agg_stage", AGGREGATES.names, AGGREGATE_KEY, batch)
    stage(db, (0, "A", 1), (0, "B", 1))
    apply(db, sql("c/0"))
    stage(db, (0, "A", 2), (1, "A", 5))
    apply(db, sql("c/1"))
    assert state(db) == [("A", 2, 2.0), ("A", 5, 5.0), ("B", 1, 1.0)]
    stage(db, (0, "A", 1), (0, "B", 1))
    apply(db, sql("c/0"))
    assert state(db) == [("A", 2, 2.0), ("A", 5, 5.0), ("B", 1, 1.0)]
    # A lost checkpoint has another name, and its batches count again.
    apply(db, sql("d/0"))
    assert state(db) == [("A", 1, 1.0), ("A", 5, 5.0), ("B", 1, 1.0)]


def test_append_happens_once_per_batch(db):
    db.execute("CREATE TABLE stocks AS SELECT * FROM agg")
    stage(db, (0, "A", 1), (0, "A", 1))
    for batch in ("c/0", "c/0", "c/1"):
        apply(db, jdbc.append_sql("stocks", "agg_stage", AGGREGATES.names, batch))
    assert db.execute("SELECT count(*) FROM stocks").fetchone() == (4,)


class Connection:
    def __init__(self, fail_at=None):
        self.calls, self.fail_at = [], fail_at

    def createStatement(self):
        return self

    def execute(self, sql):
        self.calls.append(sql)
        if sql == self.fail_at:
            raise RuntimeError("refused")

    def __getattr__(self, name):
        return lambda *args: self.calls.append(name)


def test_transaction_commits_or_rolls_back():
    good, bad = Connection(), Connection("two")
    jdbc.run_in_transaction(None, TARGET, ["one", "two"], lambda *a: good)
    assert good.calls == ["setAutoCommit", "one", "two", "commit", "close", "close"]
    with pytest.raises(RuntimeError):
        jdbc.run_in_transaction(None, TARGET, ["one", "two", "three"], lambda *a: bad)
    assert bad.calls == ["setAutoCommit", "one", "two", "rollback", "close", "close"]


def test_upsert_leaves_out_rows_without_key(spark, monkeypatch):
    staged, ran = [], []
    monkeypatch.setattr(jdbc, "_stage", lambda rows, *a: staged.append(rows.count()) or "s")
    monkeypatch.setattr(jdbc, "run_in_transaction", lambda s, t, statements: ran.extend(statements))
    rows = spark.createDataFrame([(1, "A", 2), (1, None, 3), (None, "A", 4)], "window_start int, symbol string, n int")
    jdbc.write_upsert(rows, TARGET, "agg", AGGREGATE_KEY, "c/0")
    assert staged == [1] and len(ran) == 5
    assert ran[2].endswith("DO UPDATE SET n = EXCLUDED.n") and ran[4] == "DROP TABLE s"
    assert sorted(r.n for r in jdbc.without_key(rows, AGGREGATE_KEY).collect()) == [3, 4]


def test_tables_are_created_with_their_key():
    con = duckdb.connect()
    con.execute(jdbc.ledger_ddl())
    for _ in range(2):
        con.execute(jdbc.table_ddl("stocks", STOCKS))
        con.execute(jdbc.table_ddl("agg", AGGREGATES, AGGREGATE_KEY))
    names = [r[0] for r in con.execute("DESCRIBE stocks").fetchall()]
    assert names == STOCKS.names
    con.execute("CREATE TABLE agg_stage AS SELECT * FROM agg WHERE false")
    sql = lambda batch: jdbc.upsert_sql("agg", "agg_stage", AGGREGATES.names, AGGREGATE_KEY, batch)
    for n in (1, 2):
        stage(con, (0, "A", n))
        apply(con, sql(f"c/{n}"))
    assert state(con) == [("A", 2, 2.0)]


def test_two_writers_have_their_own_stages(db):
    """The second fills its stage before the first merges."""
    stages = {c: jdbc.stage_name("agg", f"{c}/0") for c in "cd"}
    assert len(set(stages.values())) == 2
    for (name, table), symbol in zip(stages.items(), "AB"):
        stage(db, (0, symbol, 1))
        db.execute(f"CREATE TABLE {table} AS SELECT * FROM agg_stage")
    for name, table in stages.items():
        apply(db, jdbc.upsert_sql("agg", table, AGGREGATES.names, AGGREGATE_KEY, f"{name}/0"))
    assert state(db) == [("A", 1, 1.0), ("B", 1, 1.0)]


def test_checkpoint_has_a_lasting_name(spark, tmp_path):
    one, two = (checkpoint_id(spark, str(tmp_path / c)) for c in "ab")
    assert one != two and checkpoint_id(spark, str(tmp_path / "a")) == one


def test_table_is_read_in_slices_between_its_ends(spark, monkeypatch):
    asked = []
    ends = spark.sql("SELECT timestamp'2024-01-01' low, timestamp'2024-03-01 12:00:00' high")
    monkeypatch.setattr(tables, "read_jdbc", lambda s, options: asked.append(options) or ends)
    tables.read_table(spark, TARGET, "stocks", "timestamp")
    assert asked[0]["query"].endswith("max(timestamp) AS high FROM stocks")
    assert (asked[1]["lowerBound"], asked[1]["upperBound"]) == (
        "2024-01-01 00:00:00",
        "2024-03-01 12:00:00",
    )
    empty = spark.sql("SELECT cast(null AS timestamp) low, cast(null AS timestamp) high")
    monkeypatch.setattr(tables, "read_jdbc", lambda s, options: asked.append(options) or empty)
    tables.read_table(spark, TARGET, "stocks", "timestamp")
    assert asked[-1]["dbtable"] == "stocks" and "partitionColumn" not in asked[-1]


def test_pipeline_into_a_database(spark, tmp_path, monkeypatch):
    """Good rows and windows go to the database, unusable messages into the folder."""
    config = PipelineConfig(
        checkpoint=str(tmp_path / "checkpoint"),
        tables=str(tmp_path / "tables"),
        trigger=None,
        state_partitions=2,
        jdbc=TARGET,
    )
    got = {}

    def keep(rows, target, table, *rest):
        got.setdefault(table, []).append((rest[-1], [tuple(r) for r in rows.collect()]))

    monkeypatch.setattr(pipeline, "write_once", keep)
    monkeypatch.setattr(pipeline, "write_upsert", keep)
    land(str(tmp_path / "in"), [message("A", "2024-01-01 09:30:00", 2.0), "not json"], "0.txt")
    run_available(spark, read_files(spark, str(tmp_path / "in")), config)
    batch, rows = got["stocks"][0]
    assert rows == [("A", 2.0, 2.0, 2.0, 2.0, datetime(2024, 1, 1, 9, 30))]
    assert batch.endswith("/0")
    batch, rows = got["stocks_aggregates_1m"][0]
    assert [r[2:] for r in rows] == [("A", 2.0, 2.0, 2.0, 1)]
    assert [bytes(r.raw_value) for r in read_quarantine(spark, config.stocks).collect()] == [b"not json"]
    assert read_stocks(spark, config.stocks).count() == 0


def test_options():
    assert "secret" not in repr(TARGET)
    got = jdbc_options(TARGET, "stocks", "timestamp", "2024-01-01", "2024-02-01")
    assert got["dbtable"] == "stocks" and got["numPartitions"] == "4"
    assert (got["partitionColumn"], got["lowerBound"]) == ("timestamp", "2024-01-01")
    assert got["driver"] == "org.postgresql.Driver"
