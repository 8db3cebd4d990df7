"""The panels as one SQL statement each, for a database that answers them itself.

A panel is described once: its columns, what they are called, and how it groups and sorts. The statement is made from
that, in plain SQL that PostgreSQL and DuckDB read alike (Spark with its own quotes), and goes to the database through the reader's `query`
option, so that only the answer is fetched. `dashboard` has the same panels over DataFrames; tests compare the two.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tickloom.sinks.jdbc import JdbcTarget
from tickloom.sources.tables import read_jdbc


@dataclass(frozen=True)
class Panel:
    """What a panel shows: (expression, title) pairs over rows of the table.

    `newest_by` takes the newest row of each value of a column, a missing time as the newest. `ranged` panels look
    at a time range, both ends included.
    """

    columns: tuple[tuple[str, str], ...]
    order: tuple[str, ...] = ()
    group: str | None = None
    newest_by: str | None = None
    ranged: bool = False


# The panels and their titles.
PANELS = {
    "total": Panel(columns=(("count(*)", "total_records"),)),
    "latest": Panel(
        columns=(
            ("symbol", "symbol"),
            ("close", "Latest Close"),
            ("high", "Day High"),
            ("low", "Day Low"),
            ("open", "Day Open"),
            ("timestamp", "Last Updated"),
        ),
        newest_by="symbol",
        order=("symbol",),
    ),
    "series": Panel(
        columns=(("timestamp", "time"), ("symbol", "metric"), ("close", "close")),
        order=("time", "metric", "close"),
        ranged=True,
    ),
    "spread": Panel(
        columns=(
            ("symbol", "symbol"),
            (
                "cast(round(cast(avg({high} - {low}) AS decimal(38,10)), 4) AS {double})",
                "avg_daily_spread",
            ),
        ),
        group="symbol",
        order=("-avg_daily_spread", "symbol"),
        ranged=True,
    ),
}
_NAMES = ("symbol", "open", "high", "low", "close", "timestamp")


def _literal(bound: str | datetime) -> str:
    """A timestamp literal; only what reads as a time gets into the statement."""
    time = datetime.fromisoformat(bound) if isinstance(bound, str) else bound
    return f"TIMESTAMP '{time.isoformat(sep=' ')}'"


def statement(
    name: str,
    table: str = "stocks",
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    quote: str = '"',
    double: str = "double precision",
) -> str:
    """The panel's statement. `quote` is the sign around names (`timestamp` is a word of the language), `double` a type's name."""
    panel = PANELS[name]

    def named(column: str) -> str:
        return f"{quote}{column}{quote}"

    def expression(text: str) -> str:
        return named(text) if text in _NAMES else text.format(double=double, **{c: named(c) for c in _NAMES})

    columns = ", ".join(f"{expression(e)} AS {named(title)}" for e, title in panel.columns)
    source = table
    if panel.newest_by:
        key, time = named(panel.newest_by), named("timestamp")
        newest = f"row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN {time} IS NULL THEN 0 ELSE 1 END, {time} DESC)"
        source = f"(SELECT {table}.*, {newest} AS newest FROM {table}) ranked"
    wanted = ["newest = 1"] if panel.newest_by else []
    if panel.ranged:
        wanted += [f"{named('timestamp')} >= {_literal(start)}"] if start is not None else []
        wanted += [f"{named('timestamp')} <= {_literal(end)}"] if end is not None else []
    parts = [f"SELECT {columns} FROM {source}"]
    if wanted:
        parts.append("WHERE " + " AND ".join(wanted))
    if panel.group:
        parts.append(f"GROUP BY {named(panel.group)}")
    if panel.order:
        keys = (named(k.lstrip("-")) + (" DESC" if k.startswith("-") else "") for k in panel.order)
        parts.append("ORDER BY " + ", ".join(keys))
    return " ".join(parts)


def ask(spark: SparkSession, target: JdbcTarget, name: str, start=None, end=None, table: str = "stocks") -> DataFrame:
    """A panel's answer from the database."""
    return read_jdbc(spark, {**target.login(), "query": statement(name, table, start, end)})
