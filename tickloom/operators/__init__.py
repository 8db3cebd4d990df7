"""DataFrame-to-DataFrame operators; each works on tables and, where it makes sense, on streams."""

from tickloom.operators.bars import ohlc_bars
from tickloom.operators.latest import last_not_null, latest_per_key, newest_version
from tickloom.operators.parse import accepted, parse_messages, quarantined
from tickloom.operators.payload import build_payloads, unpivot_payloads
from tickloom.operators.series import long_series, wide_series
from tickloom.operators.spread import average_spread
from tickloom.operators.universe import keep_listed, keep_symbols
from tickloom.operators.windows import drop_resent, window_aggregate

__all__ = [
    "accepted",
    "average_spread",
    "build_payloads",
    "drop_resent",
    "keep_listed",
    "keep_symbols",
    "last_not_null",
    "latest_per_key",
    "long_series",
    "newest_version",
    "ohlc_bars",
    "parse_messages",
    "quarantined",
    "unpivot_payloads",
    "wide_series",
    "window_aggregate",
]
