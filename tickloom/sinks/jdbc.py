"""Database tables: executors fill a staging table, then one transaction moves its rows.

The driver sends two statements and sees no rows. A ledger row per batch, written in the same
transaction, makes a batch that is delivered again change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.sinks import fs

LEDGER = "applied_batches"
SQL_TYPES = {
    "string": "TEXT",
    "double": "DOUBLE PRECISION",
    "integer": "INTEGER",
    "long": "BIGINT",
    "timestamp": "TIMESTAMP",
}


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "org.postgresql.Driver"
    connections: int = 16

    def login(self) -> dict[str, str]:
        return {
            "url": self.url,
            "user": self.user,
            "password": self.password,
            "driver": self.driver,
        }

    def options(self, table: str) -> dict[str, str]:
        return {**self.login(), "dbtable": table, "numPartitions": str(self.connections)}


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that stays with a checkpoint folder; batch numbers are unique under it."""
    known = fs.marker(spark, checkpoint, "_id")
    if known is None:
        known = uuid.uuid4().hex
        fs.create(spark, f"{checkpoint}/_id={known}")
    return known


def append_sql(table: str, stage: str, columns: Sequence[str], batch: str) -> list[str]:
    """Add the staged rows unless the batch has been applied to the table already."""
    names = ", ".join(columns)
    return [
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} "
        f"WHERE NOT EXISTS ({_applied(table, batch)})",
        _record(table, batch),
    ]


def upsert_sql(
    table: str, stage: str, columns: Sequence[str], keys: Sequence[str], batch: str
) -> list[str]:
    """Insert the staged rows, or update those whose key is there, in one statement.

    The table needs a unique constraint on the keys.
    """
    names = ", ".join(columns)
    updates = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c not in keys)
    return [
        f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} "
        f"WHERE NOT EXISTS ({_applied(table, batch)}) "
        f"ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {updates}",
        _record(table, batch),
    ]


def table_ddl(table: str, columns: T.StructType, keys: Sequence[str] = ()) -> str:
    """A table for rows of these columns; with the keys that an upsert needs to be unique."""
    lines = [f"{f.name} {SQL_TYPES[f.dataType.typeName()]}" for f in columns]
    if keys:
        lines.append(f"PRIMARY KEY ({', '.join(keys)})")
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(lines)})"


def ledger_ddl() -> str:
    return (
        f"CREATE TABLE IF NOT EXISTS {LEDGER} "
        "(target VARCHAR(200), batch VARCHAR(100), PRIMARY KEY (target, batch))"
    )


def _applied(table: str, batch: str) -> str:
    return f"SELECT 1 FROM {LEDGER} WHERE target = '{table}' AND batch = '{batch}'"


def _record(table: str, batch: str) -> str:
    return (
        f"INSERT INTO {LEDGER} (target, batch) VALUES ('{table}', '{batch}') "
        "ON CONFLICT DO NOTHING"
    )


def write_once(rows: DataFrame, target: JdbcTarget, table: str, batch: str) -> None:
    """Append a batch to a table without keys, once however often it is delivered.

    The table is created if it is not there.
    """
    stage = _stage(rows, target, table, batch)
    statements = append_sql(table, stage, rows.columns, batch)
    _merge(rows, target, [table_ddl(table, rows.schema), *statements], stage)


def write_upsert(
    rows: DataFrame, target: JdbcTarget, table: str, keys: Sequence[str], batch: str
) -> None:
    """Bring a batch of keyed rows into a table; the batch written last wins.

    The table is created if it is not there. Rows without a key cannot go in, since NULL keys
    never conflict: the caller keeps those of `without_key` elsewhere.
    """
    rows = rows.dropna(subset=list(keys))
    stage = _stage(rows, target, table, batch)
    statements = upsert_sql(table, stage, rows.columns, keys, batch)
    _merge(rows, target, [table_ddl(table, rows.schema, keys), *statements], stage)


def without_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that `write_upsert` leaves out."""
    return rows.where(F.greatest(*(F.col(k).isNull() for k in keys)))


def stage_name(table: str, batch: str) -> str:
    """A stage of its own for each checkpoint, so that two writers never fill the same one."""
    return f"{table}_stage_{batch.split('/')[0]}"


def _stage(rows: DataFrame, target: JdbcTarget, table: str, batch: str) -> str:
    stage = stage_name(table, batch)
    rows.write.format("jdbc").options(**target.options(stage)).mode("overwrite").save()
    return stage


def _merge(rows: DataFrame, target: JdbcTarget, statements: Sequence[str], stage: str) -> None:
    """Move the staged rows, note the batch and drop the stage, all in one transaction."""
    statements = [ledger_ddl(), *statements, f"DROP TABLE {stage}"]
    run_in_transaction(rows.sparkSession, target, statements)


def run_in_transaction(
    spark: SparkSession,
    target: JdbcTarget,
    statements: Sequence[str],
    connect: Callable | None = None,
) -> None:
    """Run statements over one connection; all of them take effect or none."""
    connection = (connect or _connect)(spark, target)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            for sql in statements:
                statement.execute(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()


def _connect(spark: SparkSession, target: JdbcTarget):
    jvm = spark._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(target.driver)
    return jvm.java.sql.DriverManager.getConnection(target.url, target.user, target.password)
