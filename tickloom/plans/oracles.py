"""The same queries in DuckDB's SQL, over views named like the tables."""

from __future__ import annotations

_TICKS = """s AS (
  SELECT event_type AS symbol, value AS open, value AS high, value AS low, value AS close,
         ts AS "timestamp"
  FROM events
)"""

_BARS = """b AS (
  SELECT event_type AS symbol, arg_min(value, ts) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, ts) AS close,
         time_bucket(INTERVAL '5 minutes', ts) AS "timestamp"
  FROM events
  GROUP BY event_type, time_bucket(INTERVAL '5 minutes', ts)
)"""

_LINES = """l AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_extendedprice AS high, l_extendedprice AS low,
         l_extendedprice AS close, l_shipdate AS "timestamp"
  FROM lineitem
)"""

# What can be read of the spoilt messages; kinds 0 to 4 give nothing.
_LOOSE = """m AS (
  SELECT CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4, 8) THEN event_type END AS symbol,
         CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4, 7) THEN value END AS open,
         CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4, 6) THEN value END AS high,
         CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4) THEN value END AS low,
         CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4) THEN value END AS close,
         CASE WHEN event_id % 97 NOT IN (0, 1, 2, 3, 4, 5) THEN ts END AS "timestamp"
  FROM events
)"""

_SYMBOLS = ("click", "error", "purchase", "signup", "view")
_SPAN = "BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"


def _latest(table: str) -> str:
    return f"""SELECT DISTINCT ON (symbol) symbol, close AS "Latest Close", high AS "Day High",
  low AS "Day Low", open AS "Day Open", "timestamp" AS "Last Updated"
FROM {table} ORDER BY symbol, "timestamp" DESC NULLS FIRST"""


def _windows(table: str, width: str, where: str = "true") -> str:
    start = f"""time_bucket(INTERVAL '{width}', "timestamp")"""
    return f"""SELECT {start} AS window_start, {start} + INTERVAL '{width}' AS window_end, symbol,
  CAST(round(CAST(avg(close) AS DECIMAL(38,10)), 6) AS DOUBLE) AS avg_close,
  min(low) AS min_low, max(high) AS max_high, count(close) AS trade_count
FROM {table} WHERE {where} GROUP BY {start}, symbol"""


def _spread(where: str) -> str:
    return f"""SELECT symbol,
  CAST(round(CAST(avg(high - low) AS DECIMAL(38,10)), 4) AS DOUBLE) AS avg_daily_spread
FROM b WHERE {where} GROUP BY symbol ORDER BY avg_daily_spread DESC, symbol"""


def _series(where: str) -> str:
    return f"""SELECT "timestamp" AS time, symbol AS metric, close
FROM s WHERE {where} ORDER BY 1, 2"""


def _wide(time: str) -> str:
    columns = ", ".join(
        f"""arg_max(close, "timestamp") FILTER (WHERE symbol = '{s}') AS "{s}\"""" for s in _SYMBOLS
    )
    return f"""SELECT {time} AS time, {columns} FROM s WHERE "timestamp" {_SPAN} GROUP BY {time}"""


_PART = """"timestamp" BETWEEN TIMESTAMP '2024-01-05 10:30:00' AND TIMESTAMP '2024-01-24 16:05:00'"""
_ROWS = 'SELECT symbol, open, high, low, close, "timestamp" FROM '
_HOUR = """time_bucket(INTERVAL '1 hour', "timestamp")"""
_AFTER_END = f"{_HOUR} + INTERVAL '1 hour'"
_WATERMARK = """(SELECT date_trunc('milliseconds', max("timestamp")) - INTERVAL '2 minutes'
  FROM s)"""
_LAST_WEEK = '"timestamp" >= (SELECT max("timestamp") - INTERVAL 7 DAY FROM {})'

ORACLES: dict[str, str] = {
    "latest_quotes": f"WITH {_TICKS} {_latest('s')}",
    "latest_quotes_bars": f"WITH {_BARS} {_latest('b')}",
    "total_records": f"WITH {_TICKS} SELECT count(*) AS total_records FROM s",
    "close_series": f"""WITH {_TICKS} {_series(f'"timestamp" {_SPAN}')}""",
    "close_series_7d": f"WITH {_TICKS} {_series(_LAST_WEEK.format('s'))}",
    "close_wide": f"""WITH {_TICKS} {_wide('"timestamp"')}""",
    "close_wide_1h": f"""WITH {_TICKS} {_wide(_HOUR)}""",
    "avg_spread": f"""WITH {_BARS} {_spread(f'"timestamp" {_SPAN}')}""",
    "avg_spread_7d": f"WITH {_BARS} {_spread(_LAST_WEEK.format('b'))}",
    "last_known_close": f"""WITH {_TICKS} SELECT symbol, arg_max(close, "timestamp") AS close
FROM s WHERE close >= 20 GROUP BY symbol""",
    "symbol_filter": f"WITH {_TICKS} {_ROWS} s WHERE symbol IN ('click', 'view')",
    "symbol_listed": f"""WITH {_TICKS} {_ROWS} s
WHERE symbol IN (SELECT symbol FROM s WHERE symbol < 'p')""",
    "agg_1m": f"WITH {_TICKS} {_windows('s', '1 minute')}",
    "agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour')}",
    "resent_agg_1h": f"""WITH {_TICKS}, sent AS (SELECT * FROM s UNION ALL SELECT * FROM s)
{_windows('sent', '1 hour')}""",
    "dedup_agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour')}",
    "agg_1m_bars": f"WITH {_BARS} {_windows('b', '1 minute')}",
    "agg_lines_1d": f"WITH {_LINES} {_windows('l', '1 day')}",
    "ohlc_bars": f"WITH {_BARS} {_ROWS} b",
    "wire_roundtrip": f"WITH {_TICKS} {_ROWS} s",
    "quarantine_counts": """SELECT CASE
    WHEN event_id % 97 IN (0, 3, 4, 7) THEN 'malformed'
    WHEN event_id % 97 IN (1, 2) THEN 'empty'
    WHEN event_id % 97 = 5 THEN 'bad_time'
    WHEN event_id % 97 IN (6, 8) THEN 'missing_field'
    ELSE 'ok' END AS fault, count(*) AS messages
FROM events GROUP BY ALL""",
    "loose_stocks": f"WITH {_LOOSE} {_ROWS} m",
    "loose_agg_1h": f"""WITH {_LOOSE} {_windows('m', '1 hour', '"timestamp" IS NOT NULL')}""",
    "foreign_messages": """WITH feed AS (
  SELECT 'ok' AS fault, 0 AS bytes FROM events
  UNION ALL SELECT 'bad_time', strlen(props) FROM events
  UNION ALL SELECT 'malformed', strlen(html) FROM pages
  UNION ALL SELECT 'malformed', strlen(text) FROM documents
)
SELECT fault, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS kept_bytes
FROM feed GROUP BY fault""",
    "payload_unpivot": f"WITH {_BARS} {_ROWS} b",
    "payload_repeated_keys": f"WITH {_BARS} {_ROWS} b",
    "payload_faults": f"""WITH {_BARS}
SELECT 'ok' AS fault, count(*) AS "rows" FROM b
UNION ALL SELECT 'no_metadata', count(*) FROM events
UNION ALL SELECT 'malformed', count(*) FROM pages""",
    "stream_agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour')}",
    "final_agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour', f'{_AFTER_END} <= {_WATERMARK}')}",
    "stream_raw": f"WITH {_TICKS} {_ROWS} s",
    "pipeline_stocks": f"WITH {_TICKS} {_ROWS} s",
    "pipeline_aggregates": f"WITH {_TICKS} {_windows('s', '1 minute')}",
    "pipeline_folded": f"""WITH {_TICKS}
{_windows('s', '1 minute')} UNION ALL {_windows('s', '1 hour')}""",
    "late_resend_agg_1h": f"""WITH {_TICKS}, sent AS (
  SELECT * FROM s
  UNION ALL SELECT * FROM s WHERE {_AFTER_END} > {_WATERMARK}
) {_windows('sent', '1 hour')}""",
    "dedup_resend_agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour')}",
    "stream_quarantine": "SELECT 'malformed' AS fault, html FROM pages",
    "ingest_run": f"WITH {_BARS} {_ROWS} b",
    "ingest_two_runs": f"WITH {_BARS} {_ROWS} b",
    "late_rows_resend": f"""WITH {_TICKS}
SELECT symbol, open, high, low, close, "timestamp", {_WATERMARK} AS judged_by
FROM s WHERE {_AFTER_END} <= {_WATERMARK}""",
    "total_from_summary": f"WITH {_BARS} SELECT count(*) AS total_records FROM b",
    "latest_from_summary": f"WITH {_BARS} {_latest('b')}",
    "spread_from_summary": f"WITH {_BARS} {_spread(_PART)}",
    "folded_symbol": f"WITH {_BARS} {_ROWS} b WHERE symbol = 'view'",
    "statement_spread": f"""WITH {_BARS} {_spread(_PART)}""",
    "statement_series": f"""WITH {_BARS} SELECT "timestamp" AS time, symbol AS metric, close FROM b WHERE {_PART}""",
    "open_windows_1h": f"""WITH {_TICKS}
SELECT DISTINCT {_HOUR} AS window_start, {_AFTER_END} AS window_end, symbol
FROM s WHERE {_AFTER_END} > {_WATERMARK}""",
    "batch_counts": """SELECT 0::BIGINT AS batch, count(*) FILTER (event_type < 'f') AS "rows", 0::BIGINT AS faulty FROM events
UNION ALL SELECT 1, count(*), count(*) FILTER (event_id % 97 < 9) FROM events
UNION ALL SELECT 2, count(*) FILTER (event_type >= 'f'), 0 FROM events""",
    "empty_batches": f"WITH {_TICKS} {_ROWS} s",
    "lost_runs": "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type = 'error'",
    "timed_agg_1h": f"WITH {_TICKS} {_windows('s', '1 hour')}",
    "ingest_resent": f"WITH {_BARS} {_ROWS} b",
    "pipeline_two_feeds": f"WITH {_TICKS} {_ROWS} s",
}
