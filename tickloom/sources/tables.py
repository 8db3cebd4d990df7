from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.sinks.jdbc import JdbcTarget


def jdbc_options(
    target: JdbcTarget, table: str, column: str, lower: str, upper: str, fetch_size: int = 10_000
) -> dict[str, str]:
    """Read a table in `target.connections` slices of `column`, a date, timestamp or number.

    The bounds only place the slices; no row is left out.
    """
    return {
        **target.options(table),
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "fetchsize": str(fetch_size),
    }


def read_table(spark: SparkSession, target: JdbcTarget, table: str, column: str) -> DataFrame:
    """A whole table in slices of `column`, whose ends the database tells first."""
    ends = f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"
    ask = {**target.login(), "query": ends}
    low, high = read_jdbc(spark, ask).first()
    if low is None:
        return read_jdbc(spark, {**target.login(), "dbtable": table})
    return read_jdbc(spark, jdbc_options(target, table, column, str(low), str(high)))


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
