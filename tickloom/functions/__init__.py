"""Column expressions used by the operators."""

from tickloom.functions.expr import (
    decode_text,
    decimal_round,
    encode_wire,
    json_struct,
    price,
    time_literal,
    time_range,
    unset_first,
    utc_date,
)

__all__ = [
    "decode_text",
    "decimal_round",
    "encode_wire",
    "json_struct",
    "price",
    "time_literal",
    "time_range",
    "unset_first",
    "utc_date",
]
