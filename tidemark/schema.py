"""The bar table: fixed columns, interval names and series keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SERIES = ["symbol", "interval"]
PRICE_COLUMNS = ["open", "high", "low", "close", "volume", "quote_volume"]
BAR_COLUMNS = ["open_time", *PRICE_COLUMNS, "trades", "close_time"]
BAR_SCHEMA = (
    "symbol string, interval string, open_time timestamp_ntz, open double, high double, "
    "low double, close double, volume double, quote_volume double, trades bigint, "
    "close_time timestamp_ntz"
)

# Interval name -> (window duration, hours per bar).
INTERVALS = {
    "30m": ("30 minutes", 0.5),
    "1h": ("1 hour", 1.0),
    "4h": ("4 hours", 4.0),
    "1d": ("1 day", 24.0),
}
HISTORY_START = "2020-01-01 00:00:00"
HOURS_PER_YEAR = 365 * 24


def duration(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}; known: {sorted(INTERVALS)}")
    return INTERVALS[interval][0]


def interval_length(interval: str) -> Column:
    """The interval as a day-time interval literal."""
    return F.expr(f"INTERVAL '{int(INTERVALS[interval][1] * 60)}' MINUTE")


MILLISECOND = "INTERVAL '0.001' SECOND"
