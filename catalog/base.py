"""Fixtures shared by the registered queries, on both the Spark and the SQL side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.series import with_ordinal
from tidemark.plans.staging import stage
from tidemark.sources.ticks import ticks_to_bars, with_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- Spark side ---------------------------------------------------------------------------------

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def bars(spark: SparkSession, sf: str, interval: str = "1h") -> DataFrame:
    """The bar table: written once, so later steps re-read bars and never the ticks."""
    return stage(ticks_to_bars(ticks(spark, sf), interval))


def indexed(spark: SparkSession, sf: str, interval: str = "1h") -> DataFrame:
    return with_ordinal(bars(spark, sf, interval))


def line_sequence(lineitem: DataFrame) -> Column:
    """The order of line items by date, order and line number; a whole number inside a day where all of them allow it."""
    day, order, number = F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")
    packs = (day == day.cast("date")) & number.between(0, 7) & order.between(-(2**60), 2**60 - 1)
    if lineitem.where(~F.coalesce(packs, F.lit(False))).isEmpty():
        return order * 8 + number
    return F.struct(day, order, number)


def daily_ticks(spark: SparkSession, sf: str, by: str = "region") -> DataFrame:
    lineitem = table(spark, sf, "lineitem")
    line = with_place(lineitem).select(
        "l_suppkey", F.col("l_shipdate").alias("ts"), "place",
        # ticks of a day share their ts; order lines number them, and rows of the same order line their places
        line_sequence(lineitem).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
    )
    if by == "supplier":
        return line.withColumn("symbol", F.col("l_suppkey").cast("string"))
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("symbol"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    return line.join(supplier, "l_suppkey").join(nation, "n_nationkey").join(region, "n_regionkey")


def daily_bars(spark: SparkSession, sf: str, by: str = "region") -> DataFrame:
    return stage(ticks_to_bars(daily_ticks(spark, sf, by), "1d", sequence="seq", place="place"))


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Seven significant digits (seven decimals below one), no -0.0: both engines print the same."""
    def shown(name: str):
        x = F.col(name)
        q = F.floor(F.log10(F.abs(x))) - (digits - 1)
        big = F.when(q >= 0, F.round(x / F.pow(F.lit(10.0), q), 0) * F.pow(F.lit(10.0), q)).otherwise(
            F.round(x * F.pow(F.lit(10.0), -q), 0) / F.pow(F.lit(10.0), -q)
        )
        plain = (F.abs(x) < 1) | (F.abs(x) == float("inf"))
        return (F.when(plain, F.round(x, digits)).otherwise(big) + F.lit(0.0)).alias(name)

    return df.select(*[
        shown(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields
    ])


# --- SQL side -----------------------------------------------------------------------------------

def r(expr: str, name: str | None = None, digits: int = 7) -> str:
    x, q = f"({expr})", f"(floor(log10(abs({expr}))) - {digits - 1})"
    return (
        f"CASE WHEN abs{x} < 1 OR isinf({x}::DOUBLE) THEN round({x}::DOUBLE, {digits}) WHEN {q} >= 0 "
        f"THEN round({x} / power(10.0::DOUBLE, {q})) * power(10.0::DOUBLE, {q}) "
        f"ELSE round({x} * power(10.0::DOUBLE, -{q})) / power(10.0::DOUBLE, -{q}) END + 0.0 AS {name or expr}"
    )


def rs(names: str, digits: int = 7) -> str:
    return ", ".join(r(n, None, digits) for n in names.split())


WIDTHS = {"30m": "30 MINUTE", "1h": "1 HOUR", "4h": "4 HOUR", "1d": "1 DAY"}

TICKS = """ticks AS (SELECT event_type AS symbol, ts, value AS price,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS qty FROM events)"""


def bars_sql(interval: str = "1h", name: str = "bars", source: str = "ticks", seq: str = "ts") -> str:
    width = WIDTHS[interval]
    return f"""{name} AS (SELECT symbol, '{interval}' AS "interval", time_bucket(INTERVAL {width}, ts) AS open_time,
  arg_min(price, {seq}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {seq}) AS close,
  sum(qty) AS volume, sum(price * qty) AS quote_volume, count(*) AS trades,
  time_bucket(INTERVAL {width}, ts) + INTERVAL {width} - INTERVAL 1 MILLISECOND AS close_time
  FROM {source} GROUP BY ALL)"""


def indexed_sql(source: str = "bars", name: str = "ib", keys: str = "symbol") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY open_time) - 1 AS bar_idx,
  count(*) OVER (PARTITION BY {keys}) AS n_bars FROM {source})"""


REGION_TICKS = """ticks AS (SELECT r_name AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS qty, (l_shipdate, l_orderkey, l_linenumber) AS seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SUPPLIER_TICKS = """ticks AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts,
  l_extendedprice / l_quantity AS price, l_quantity AS qty, (l_shipdate, l_orderkey, l_linenumber) AS seq FROM lineitem)"""

HOURLY = f"{TICKS}, {bars_sql()}, {indexed_sql()}"
DAILY = f"{REGION_TICKS}, {bars_sql('1d', seq='seq')}, {indexed_sql()}"


def smooth_sql(
    period: str = "24", scale: str = "1", source: str = "ib", name: str = "sm", keys: str = "symbol",
    x: str = "close", out: str = "smoothed",
) -> str:
    """Low pass as an explicit cosine basis: only the bins below the cut-off are summed."""
    ks = keys
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in ks.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in ks.split(","))
    return f"""{name}_p AS (SELECT *, CAST(floor(cut * m) AS BIGINT) AS e,
    greatest(1, CAST(floor(0.1::DOUBLE * floor(cut * m)) AS BIGINT)) AS w FROM (
    SELECT {ks}, n, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS pad, n + 2 * CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS m,
    CASE WHEN pd <= 0 THEN 1.0 ELSE least(((n / pd) * sc) / (n / 2.0::DOUBLE), 1.0) END AS cut FROM (
    SELECT {ks}, n_bars AS n, ({period})::DOUBLE AS pd, ({scale})::DOUBLE AS sc FROM {source} WHERE bar_idx = 0))),
  {name}_x AS (SELECT {pk}, p.n, p.pad, p.m, p.e, p.w, b.j, s.{x} AS v FROM {name}_p p,
    LATERAL (SELECT unnest(range(p.m)) AS j) b JOIN {source} s ON {on('s', 'p')} AND s.bar_idx =
    CASE WHEN b.j < p.pad THEN p.pad - b.j WHEN b.j >= p.pad + p.n THEN 2 * (p.n - 1) - (b.j - p.pad) ELSE b.j - p.pad END),
  {name}_k AS (SELECT {pk}, p.pad, p.m, b.k, CASE WHEN b.k < p.e THEN 1.0 ELSE 0.5 + 0.5 * cos(pi() * (b.k - p.e) / p.w) END AS g
    FROM {name}_p p, LATERAL (SELECT unnest(range(CASE WHEN p.e + p.w < p.m THEN p.e + p.w ELSE least(p.e, p.m) END)) AS k) b),
  {name}_c AS (SELECT {pk}, p.pad, p.m, p.k, any_value(p.g) * (CASE WHEN p.k = 0 THEN 1 ELSE 2 END)::DOUBLE / p.m
    * sum(x.v * cos(pi() * (2 * x.j + 1) * p.k / (2 * p.m))) AS c
    FROM {name}_k p JOIN {name}_x x ON {on('x', 'p')} GROUP BY {pk}, p.pad, p.m, p.k),
  {name} AS (SELECT s.*, f.y AS {out} FROM {source} s JOIN (SELECT {', '.join('t.' + k.strip() for k in ks.split(','))}, t.bar_idx,
    sum(p.c * cos(pi() * (2 * (t.bar_idx + p.pad) + 1) * p.k / (2 * p.m))) AS y
    FROM {source} t JOIN {name}_c p ON {on('t', 'p')} GROUP BY ALL) f ON {on('f', 's')} AND f.bar_idx = s.bar_idx)"""


# Flagship signals: residual-sigma stops, 24-bar trend, window 20, k = 2.
def signals_sql(k: str = "2", source: str = "sm", name: str = "sig", keys: str = "symbol", lookback: int = 1) -> str:
    return f"""{name}_b AS (SELECT *, coalesce(stddev_samp(close - smoothed) OVER (PARTITION BY {keys} ORDER BY bar_idx
    ROWS 19 PRECEDING), 0) AS width, lag(close) OVER w AS pc, lag(smoothed) OVER w AS ps,
    smoothed - lag(smoothed, {lookback}) OVER w AS rise FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY bar_idx)),
  {name}_s AS (SELECT *, CASE WHEN (pc >= ps AND close < smoothed) OR close < smoothed - {k} * width THEN -1
    WHEN pc <= ps AND close > smoothed AND rise > 0 THEN 1 ELSE 0 END AS signal FROM {name}_b),
  {name} AS (SELECT *, lag(signal) OVER (PARTITION BY {keys} ORDER BY bar_idx) AS sig1 FROM {name}_s)"""


def replay_sql(source: str = "sig", name: str = "acc", keys: str = "symbol", fraction: str = "1.0") -> str:
    """Sequential account, one recursion step per bar; a row is the state during that bar."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = a.{k}" for k in ks)
    sk = ", ".join(f"s.{k}" for k in ks)
    fe, fx = "(s.open * 1.0005::DOUBLE)", "(s.open * 0.9995::DOUBLE)"
    buys, sells = "(s.sig1 = 1 AND a.units = 0)", "(s.sig1 = -1 AND a.units > 0)"
    return f"""{name} AS (SELECT {', '.join(ks)}, bar_idx, open_time, close, high, low, 10000.0::DOUBLE AS cash,
    0.0::DOUBLE AS units, 0.0::DOUBLE AS ep, -1::BIGINT AS ei, NULL::TIMESTAMP AS et, NULL::DOUBLE AS xp, 0.0::DOUBLE AS xu,
    10000.0::DOUBLE AS equity FROM {source} WHERE bar_idx = 0
  UNION ALL SELECT {sk}, s.bar_idx, s.open_time, s.close, s.high, s.low,
    CASE WHEN {buys} THEN a.cash - a.cash * {fraction} WHEN {sells} THEN a.cash + a.units * {fx} * 0.999::DOUBLE ELSE a.cash END,
    CASE WHEN {buys} THEN a.cash * {fraction} / ({fe} * 1.001::DOUBLE) WHEN {sells} THEN 0 ELSE a.units END,
    CASE WHEN {buys} THEN {fe} ELSE a.ep END,
    CASE WHEN {buys} THEN s.bar_idx ELSE a.ei END, CASE WHEN {buys} THEN s.open_time ELSE a.et END,
    CASE WHEN {sells} THEN {fx} END, CASE WHEN {sells} THEN a.units ELSE 0 END,
    CASE WHEN {buys} THEN a.cash - a.cash * {fraction} + a.cash * {fraction} / ({fe} * 1.001::DOUBLE) * s.close
      WHEN {sells} THEN a.cash + a.units * {fx} * 0.999::DOUBLE ELSE a.cash + a.units * s.close END
    FROM {name} a JOIN {source} s ON {on} AND s.bar_idx = a.bar_idx + 1)"""


def trades_sql(account: str = "acc", name: str = "tr", keys: str = "symbol", bars_from: str = "ib") -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"b.{k} = t.{k}" for k in ks)
    tk = ", ".join(f"t.{k}" for k in ks)
    return f"""{name}_h AS (SELECT {tk}, t.bar_idx AS exit_idx, min(b.low) AS lo, max(b.high) AS hi
    FROM {account} t JOIN {bars_from} b ON {on} AND b.bar_idx >= t.ei AND b.bar_idx < t.bar_idx WHERE t.xu > 0 GROUP BY ALL),
  {name} AS (SELECT {keys}, ei AS entry_idx, bar_idx AS exit_idx, et AS entry_time, open_time AS exit_time, ep AS entry_price,
    xp AS exit_price, xu AS size, xu * xp - xu * ep - 0.001 * (xu * xp + xu * ep) AS pnl,
    (xu * xp - xu * ep - 0.001 * (xu * xp + xu * ep)) / (xu * ep) AS pnl_pct, ep - lo AS mae, hi - ep AS mfe,
    (ep - lo) / ep AS mae_pct, (hi - ep) / ep AS mfe_pct, bar_idx - ei AS bars_held, 0.001 * (xu * xp + xu * ep) AS fees
    FROM {account} JOIN {name}_h h USING ({keys}) WHERE xu > 0 AND bar_idx = h.exit_idx)"""


def metrics_sql(account: str = "acc", trades: str = "tr", name: str = "met", keys: str = "symbol") -> str:
    ks = [k.strip() for k in keys.split(",")]
    using = ", ".join(ks)
    return f"""{name}_q AS (SELECT *, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY bar_idx) - 1 AS ret,
    max(equity) OVER (PARTITION BY {keys} ORDER BY bar_idx) AS peak FROM {account}),
  {name}_e AS (SELECT {keys}, (arg_max(equity, bar_idx) - 10000) / 10000 AS total_return,
    arg_max(equity, bar_idx) / 10000 - 1 AS cumulative_return,
    power(arg_max(equity, bar_idx) / 10000, 8760.0::DOUBLE / count(*)) - 1 AS annualized_return,
    min(equity - peak) AS max_drawdown,
    arg_min((equity - peak) / peak, (equity - peak, bar_idx)) AS max_drawdown_pct,
    CASE WHEN count(ret) = 0 OR stddev_samp(ret) < 1e-10 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(8760) END AS sharpe_ratio,
    CASE WHEN count(ret) = 0 THEN 0 WHEN count(*) FILTER (ret < 0) = 0 OR stddev_samp(ret) FILTER (ret < 0) = 0 THEN 'inf'::DOUBLE
      ELSE avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(8760) END AS sortino_ratio
    FROM {name}_q GROUP BY {keys}),
  {name}_t AS (SELECT {keys}, count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl <= 0) AS n_losses,
    coalesce(sum(pnl) FILTER (pnl > 0), 0) AS won, abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) AS lost,
    avg(bars_held) AS avg_bars_held, avg(mae) AS avg_mae, avg(mfe) AS avg_mfe, avg(mae_pct) AS avg_mae_pct,
    avg(mfe_pct) AS avg_mfe_pct FROM {trades} GROUP BY {keys}),
  {name} AS (SELECT {name}_e.*, coalesce(n_trades, 0) AS n_trades, coalesce(n_wins, 0) AS n_wins, coalesce(n_losses, 0) AS n_losses,
    CASE WHEN n_trades > 0 THEN n_wins / n_trades ELSE 0 END AS win_rate,
    CASE WHEN n_trades IS NULL THEN 0 WHEN lost > 0 THEN won / lost ELSE 'inf'::DOUBLE END AS profit_factor,
    CASE WHEN n_wins > 0 THEN won / n_wins ELSE 0 END AS avg_win, CASE WHEN n_losses > 0 THEN lost / n_losses ELSE 0 END AS avg_loss,
    coalesce(avg_bars_held, 0) AS avg_bars_held, coalesce(avg_mae, 0) AS avg_mae, coalesce(avg_mfe, 0) AS avg_mfe,
    coalesce(avg_mae_pct, 0) AS avg_mae_pct, coalesce(avg_mfe_pct, 0) AS avg_mfe_pct
    FROM {name}_e LEFT JOIN {name}_t USING ({using}))"""


METRIC_NAMES = (
    "total_return cumulative_return annualized_return max_drawdown max_drawdown_pct sharpe_ratio sortino_ratio "
    "win_rate profit_factor avg_win avg_loss avg_bars_held avg_mae avg_mfe avg_mae_pct avg_mfe_pct"
)
SMOOTHED = f"{HOURLY}, {smooth_sql()}"
SIGNALS = f"{SMOOTHED}, {signals_sql()}"
ACCOUNT = f"{SIGNALS}, {replay_sql()}"
TRADES = f"{ACCOUNT}, {trades_sql()}"


def with_(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
