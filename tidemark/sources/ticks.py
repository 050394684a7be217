"""Bars from ticks, and bars from raw kline records."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tidemark.plans.staging import stage
from tidemark.schema import BAR_COLUMNS, MILLISECOND, PRICE_COLUMNS, duration, interval_length

# Position of each field in a raw kline record.
KLINE_FIELDS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades",
    "taker_buy_base", "taker_buy_quote", "ignore",
]


#: More rows than a file has, and more places than a whole number can name.
_FILE_ROWS, _PLACES = 2**40, Decimal(10**19)


def with_place(df: DataFrame, name: str = "place") -> DataFrame:
    """``df``, as read from files, with a whole number that grows with the file's path and the row's position in it."""
    read = df.withColumns({"_file": F.col("_metadata.file_path"), name: F.col("_metadata.row_index")})
    if len(df.inputFiles()) < 2:
        return read.drop("_file")
    files = read.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    return read.join(stage(files), "_file").withColumn(name, F.col("_rank") * F.lit(_FILE_ROWS) + F.col(name)).drop("_file", "_rank")


def ticks_to_bars(
    ticks: DataFrame, interval: str, sequence: str = "ts", keys: list[str] | None = None, place: str | None = None
) -> DataFrame:
    """OHLCV bars of ``(symbol, ts, price, qty)`` ticks.

    One hash aggregate with map-side combine: a symbol holding most of the ticks shuffles only
    (input partitions x bars) partial rows.  ``sequence`` is the fixed-width column giving the order
    of the ticks inside a bar, for data where several ticks share a ``ts``.  Where several share the
    sequence, a whole number, too, the one of the smallest ``place`` counts; without places any of them.
    The sequence may be a struct, ordered by its fields in turn; the aggregate then sorts the ticks.  Ticks without a
    price neither open nor close a bar.
    """
    keys = keys or ["symbol"]
    first = last = F.col(sequence)
    if place is not None and isinstance(ticks.schema[sequence].dataType, StructType):
        first, last = F.struct(sequence, place), F.struct(sequence, -F.col(place))
    elif place is not None:
        # a decimal has a fixed width, as a struct of both has not
        wide = F.col(sequence).cast("decimal(19,0)") * F.lit(_PLACES)
        first, last = wide + F.col(place), wide - F.col(place)
    priced = F.col("price").isNotNull()
    win = F.window("ts", duration(interval))
    bars = ticks.groupBy(*keys, win.alias("w")).agg(
        F.min_by("price", F.when(priced, first)).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.when(priced, last)).alias("close"),
        F.sum("qty").cast("double").alias("volume"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    start = F.col("w.start")
    return (
        bars.withColumn("open_time", start)
        .withColumn("close_time", start + interval_length(interval) - F.expr(MILLISECOND))
        .withColumn("interval", F.lit(interval))
        .select(*keys, "interval", *BAR_COLUMNS)
    )


def resample_bars(bars: DataFrame, interval: str, keys: list[str] | None = None) -> DataFrame:
    """Bars of a longer interval from finer ones, the same as from the ticks themselves.

    The finer interval must divide the longer one. Ticks are then read once for all intervals.
    """
    keys = keys or ["symbol"]
    win = F.window("open_time", duration(interval))
    out = bars.groupBy(*keys, win.alias("w")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"), *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades")],
    )
    start = F.col("w.start")
    return (
        out.withColumn("open_time", start)
        .withColumn("close_time", start + interval_length(interval) - F.expr(MILLISECOND))
        .withColumn("interval", F.lit(interval))
        .select(*keys, "interval", *BAR_COLUMNS)
    )


def from_epoch_ms(ms: str | Column) -> Column:
    """Epoch milliseconds to UTC wall-clock time, whatever the session time zone."""
    value = F.col(ms) if isinstance(ms, str) else ms
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(secs=(value / 1000).cast("decimal(18,6)"))


def to_epoch_ms(ts: str | Column) -> Column:
    """Wall-clock UTC time to whole epoch milliseconds (rounded towards zero)."""
    value = F.col(ts) if isinstance(ts, str) else ts
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", origin, value)
    return (micros / 1000).cast("long")


def parse_utc(text: str | Column) -> Column:
    """ISO text, with ``Z``, an offset or nothing (= UTC), to UTC wall-clock time."""
    value = F.col(text) if isinstance(text, str) else text
    tail = F.regexp_extract(value, r"([+-])(\d{2}):?(\d{2})$", 0)
    body = F.regexp_replace(value, r"(Z|[+-]\d{2}:?\d{2})$", "")
    has_offset = (tail != "") & value.contains(":")
    sign = F.when(tail.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(tail, "[^0-9]", "")
    minutes = F.when(
        has_offset, sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))
    ).otherwise(0)
    plain = F.when(has_offset | value.endswith("Z"), body).otherwise(value)
    return F.to_timestamp_ntz(plain) - F.make_dt_interval(mins=minutes)


def klines_to_bars(raw: DataFrame, record: str = "kline", keep: list[str] | None = None) -> DataFrame:
    """Typed bar columns of an ``array<string>`` kline record.

    Prices that do not parse become NULL; a trade count that does not parse is an error.
    """
    field = {name: F.element_at(record, i + 1) for i, name in enumerate(KLINE_FIELDS)}
    columns = {
        "open_time": from_epoch_ms(field["open_time"].cast("long")),
        "close_time": from_epoch_ms(field["close_time"].cast("long")),
        "trades": field["trades"].cast("bigint"),
        **{c: field[c].try_cast("double") for c in PRICE_COLUMNS},
    }
    return raw.select(*(keep or []), *[columns[c].alias(c) for c in BAR_COLUMNS])
