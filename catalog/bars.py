"""Bar sources, bar-table maintenance (A1-A10) and projections, filters, sorts."""

from __future__ import annotations


from pyspark.sql import functions as F

from catalog.base import (
    DAILY, SIGNALS, TICKS, TRADES, bars, bars_sql, daily_bars, query, r, rounded, rs, table, with_,
)
from catalog.backtests import FLAGSHIP, flagship
from tidemark.functions import columns as fx

from tidemark.plans.staging import fresh_folder, stage
from tidemark.plans.strategy import trend_signals
from tidemark.schema import BAR_COLUMNS, SERIES
from tidemark.sources import store, ticks as tk

PX = "open high low close volume quote_volume"
BAR_SELECT = f'symbol, "interval", open_time, {rs(PX)}, trades, close_time'
BARS1H = f"{TICKS}, {bars_sql()}"

# Each order becomes a raw 12-field record; prices of urgent orders are deliberately unparsable.
RAW = """raw AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS symbol, o_orderkey, o_totalprice AS p,
  epoch_ms(o_orderdate) AS t, o_orderpriority AS prio FROM orders)"""


@query("a1_kline_normalise", with_(RAW, f"""SELECT symbol, o_orderkey, make_timestamp(t * 1000) AS open_time,
  {r('p', 'open')}, {r('p + 2', 'high')}, {r('p - 2', 'low')}, {r("CASE WHEN prio LIKE '1%' THEN NULL ELSE p END", 'close')},
  1.5::DOUBLE AS volume, 2.5::DOUBLE AS quote_volume, o_orderkey AS trades,
  make_timestamp((t + 3599999) * 1000) AS close_time FROM raw"""))
def a1(spark, sf):
    o = table(spark, sf, "orders")
    ms = tk.to_epoch_ms("o_orderdate")
    price = F.col("o_totalprice")
    text = lambda c: c.cast("string")
    close = F.when(F.col("o_orderpriority").startswith("1"), F.lit("n/a")).otherwise(text(price))
    record = F.array(
        text(ms), text(price), text(price + 2), text(price - 2), close, F.lit("1.5"), text(ms + 3599999),
        F.lit("2.5"), text(F.col("o_orderkey")), F.lit("0"), F.lit("0"), F.lit("0"),
    )
    raw = o.select((F.col("o_custkey") % 7).cast("string").alias("symbol"), "o_orderkey", record.alias("kline"))
    out = tk.klines_to_bars(raw, keep=["symbol", "o_orderkey"])
    return rounded(out)


@query("a2_ticks_to_bars", with_(BARS1H, f"SELECT {BAR_SELECT} FROM bars"))
def a2(spark, sf):
    return rounded(bars(spark, sf))


@query("a2_daily_bars_by_region", with_(DAILY, f"SELECT {BAR_SELECT} FROM bars"))
def a2_daily(spark, sf):
    return rounded(daily_bars(spark, sf))


def _store(spark, sf):
    """The hourly bars written to, and read back from, a partitioned bar table."""
    path = fresh_folder(spark, "store") + "/bars"
    store.write_bars(bars(spark, sf), path)
    return path


@query("a3_parquet_scan", with_(BARS1H, f"SELECT {BAR_SELECT} FROM bars WHERE symbol = 'click'"))
def a3(spark, sf):
    return rounded(store.read_bars(spark, _store(spark, sf)).where("symbol = 'click' and interval = '1h'"))


# Several orders share a day: the last one (by key) is the version that survives.
DUPES = """SELECT symbol, '1d' AS "interval", open_time, arg_max(price, seq) AS close FROM (
  SELECT CAST(o_custkey % 7 AS VARCHAR) AS symbol, o_orderdate AS open_time, o_totalprice AS price, o_orderkey AS seq
  FROM orders) GROUP BY ALL"""


@query("a4_save_keeps_last", f"SELECT symbol, \"interval\", open_time, round(close, 2) AS close FROM ({DUPES})")
def a4(spark, sf):
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 7).cast("string").alias("symbol"), F.lit("1d").alias("interval"),
        F.col("o_orderdate").alias("open_time"), F.col("o_totalprice").alias("close"),
        F.col("o_orderkey").alias("seq"),
    )
    return store.newest_per_bar(o, "seq").withColumn("close", F.round("close", 2))


# New data: bars rebuilt from the second half of the month, with closes raised by one.
@query("a5_merge_upsert", with_(BARS1H, f"""SELECT symbol, "interval", open_time,
  {r("CASE WHEN open_time >= TIMESTAMP '2024-01-16' THEN close + 1 ELSE close END", 'close')}, trades FROM bars
  WHERE open_time < TIMESTAMP '2024-01-20' OR open_time >= TIMESTAMP '2024-01-16'"""))
def a5(spark, sf):
    b = bars(spark, sf)
    old = b.where("open_time < timestamp_ntz'2024-01-20 00:00:00'")
    new = b.where("open_time >= timestamp_ntz'2024-01-16 00:00:00'").withColumn("close", F.col("close") + 1)
    return rounded(store.upsert(old, new).select(*SERIES, "open_time", "close", "trades"))


@query("a5_merge_into_table", with_(BARS1H, f"""SELECT symbol, "interval", open_time,
  {r("CASE WHEN open_time >= TIMESTAMP '2024-01-16' AND symbol <> 'view' THEN close + 1 ELSE close END", 'close')}, trades FROM bars"""))
def a5_table(spark, sf):
    path = _store(spark, sf)
    new = bars(spark, sf).where("open_time >= timestamp_ntz'2024-01-16 00:00:00' and symbol <> 'view'")
    store.merge_bars(spark, path, new.withColumn("close", F.col("close") + 1), path + "-staging")
    return rounded(store.read_bars(spark, path).select(*SERIES, "open_time", "close", "trades"))


@query("a6_series_span", with_(BARS1H, 'SELECT symbol, "interval", min(open_time) AS first_open, max(close_time) AS last_close FROM bars GROUP BY ALL'))
def a6(spark, sf):
    return store.series_span(bars(spark, sf))


GAPS = """gaps AS (SELECT symbol, "interval", close_time AS gap_start, nxt AS gap_end FROM (SELECT *, lead(open_time)
  OVER (PARTITION BY symbol ORDER BY open_time) AS nxt FROM bars) WHERE nxt - open_time > INTERVAL '3601 seconds')"""


@query("a7_gap_detection", with_(f"{BARS1H}, {GAPS}", "SELECT * FROM gaps"))
def a7(spark, sf):
    return store.find_gaps(bars(spark, sf), "1h")


START, END = "2023-12-31 12:00:00", "2024-02-01 00:00:00"


@query("a8_missing_ranges", with_(f"{BARS1H}, {GAPS}", f"""SELECT symbol, "interval", 'head' AS kind, TIMESTAMP '{START}' AS range_start,
  min(open_time) AS range_end FROM bars GROUP BY ALL HAVING min(open_time) > TIMESTAMP '{START}'
  UNION ALL SELECT symbol, "interval", 'tail', max(close_time) + INTERVAL 1 MILLISECOND, TIMESTAMP '{END}' FROM bars GROUP BY ALL
  HAVING max(close_time) < TIMESTAMP '{END}'
  UNION ALL SELECT symbol, "interval", 'gap', gap_start + INTERVAL 1 MILLISECOND, gap_end FROM gaps"""))
def a8(spark, sf):
    return store.missing_ranges(bars(spark, sf), "1h", START, END)


@query("a8_update_start", with_(BARS1H, 'SELECT symbol, "interval", max(close_time) + INTERVAL 1 MILLISECOND AS update_from FROM bars GROUP BY ALL'))
def a8_start(spark, sf):
    return store.update_start(bars(spark, sf))


# The store lost its odd hours; the gaps are refilled from the tick table.
@query("a8_backfill", with_(f"{BARS1H}", f"SELECT {BAR_SELECT} FROM bars"))
def a8_backfill(spark, sf):
    full = stage(bars(spark, sf))
    kept = full.where("hour(open_time) % 2 = 0")
    ranges = store.missing_ranges(kept, "1h", "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    return rounded(store.backfill(kept, ranges, full).select(*SERIES, *BAR_COLUMNS))


LO, HI = "2024-01-05 06:00:00", "2024-01-09 18:00:00"


@query("a9_range_load", with_(BARS1H, f"SELECT {BAR_SELECT} FROM bars WHERE open_time BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"))
def a9(spark, sf):
    return rounded(store.load_range(spark, _store(spark, sf), "1h", LO, HI))


@query("a10_epoch_utc", """SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back,
  date_trunc('second', ts) AS parsed, date_trunc('second', ts) - INTERVAL 2 HOUR AS parsed_offset FROM events""")
def a10(spark, sf):
    ms = tk.to_epoch_ms("ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(
        "event_id", ms.alias("ms"), tk.from_epoch_ms(ms).alias("back"),
        tk.parse_utc(F.concat(iso, F.lit("Z"))).alias("parsed"),
        tk.parse_utc(F.concat(iso, F.lit("+02:00"))).alias("parsed_offset"),
    )


# --- projections, filters, sorts ----------------------------------------------------------------

@query("b1_projection", with_(BARS1H, f"SELECT open_time, {rs(PX)}, trades, close_time FROM bars"))
def b1(spark, sf):
    return rounded(bars(spark, sf).select(*BAR_COLUMNS))


@query("b2_start_filter", with_(BARS1H, f"SELECT {BAR_SELECT} FROM bars WHERE open_time >= TIMESTAMP '{LO}' ORDER BY symbol, open_time"))
def b2(spark, sf):
    return rounded(store.in_range(bars(spark, sf), LO)).orderBy("symbol", "open_time")


@query("b3_trade_filter", with_(TRADES, f"""SELECT 'winning' AS kind, symbol, entry_idx, {rs('pnl_pct')} FROM tr WHERE pnl > 0
  UNION ALL SELECT 'losing', symbol, entry_idx, {rs('pnl_pct')} FROM tr WHERE pnl <= 0"""))
def b3(spark, sf):
    t = flagship(spark, sf)[1]
    win = t.where("pnl > 0").withColumn("kind", F.lit("winning"))
    lose = t.where("pnl <= 0").withColumn("kind", F.lit("losing"))
    return rounded(win.unionByName(lose).select("kind", "symbol", "entry_idx", "pnl_pct"))


@query("b4_trade_sort", with_(TRADES, f"SELECT symbol, entry_idx, bars_held, {rs('pnl_pct')} FROM tr ORDER BY tr.pnl_pct DESC, symbol, entry_idx"))
def b4(spark, sf):
    t = flagship(spark, sf)[1].select("symbol", "entry_idx", "bars_held", "pnl_pct")
    return rounded(t.orderBy(F.desc("pnl_pct"), "symbol", "entry_idx"))


@query("b5_trade_display", with_(TRADES, """SELECT symbol, strftime(entry_time, '%Y-%m-%d %H:%M') AS entry_time,
  strftime(exit_time, '%Y-%m-%d %H:%M') AS exit_time, printf('$%.2f', entry_price) AS entry_price,
  printf('$%.2f', exit_price) AS exit_price, printf('%.2f%%', pnl_pct * 100) AS pnl_pct, bars_held,
  printf('$%.2f', mae) AS mae, printf('$%.2f', mfe) AS mfe FROM tr"""))
def b5(spark, sf):
    money = lambda c: F.format_string("$%.2f", F.col(c)).alias(c)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return flagship(spark, sf)[1].select(
        "symbol", stamp("entry_time"), stamp("exit_time"), money("entry_price"), money("exit_price"),
        F.format_string("%.2f%%", F.col("pnl_pct") * 100).alias("pnl_pct"), "bars_held", money("mae"), money("mfe"),
    )


@query("b6_signal_markers", with_(SIGNALS, f"""SELECT symbol, open_time, CASE signal WHEN 1 THEN 'entry' ELSE 'exit' END AS marker, {rs('close')}
  FROM sig WHERE signal IN (1, -1)"""))
def b6(spark, sf):
    s = trend_signals(bars(spark, sf), FLAGSHIP).where(F.col("signal").isin(1, -1))
    marker = F.when(F.col("signal") == 1, "entry").otherwise("exit").alias("marker")
    return rounded(s.select("symbol", "open_time", marker, "close"))


@query("b8_data_summary", with_(BARS1H, f"""SELECT symbol, "interval", count(*) AS n_rows, strftime(min(open_time), '%Y-%m-%d') AS first_date,
  strftime(max(open_time), '%Y-%m-%d') AS last_date, {r('avg(volume)', 'avg_volume')}, {r('min(low)', 'min_low')}, {r('max(high)', 'max_high')}
  FROM bars GROUP BY ALL"""))
def b8(spark, sf):
    return rounded(store.data_summary(bars(spark, sf)))


HOURS = """SELECT event_id, value AS hours, CASE event_type WHEN 'click' THEN '30m' WHEN 'view' THEN '1h' WHEN 'error' THEN '4h'
  ELSE 'other' END AS iv, CASE event_type WHEN 'click' THEN 0.5 WHEN 'error' THEN 4.0 ELSE 1.0 END::DOUBLE AS hpb FROM events"""


def _hours(spark, sf):
    iv = F.create_map(F.lit("click"), F.lit("30m"), F.lit("view"), F.lit("1h"), F.lit("error"), F.lit("4h"))
    return table(spark, sf, "events").select(
        "event_id", F.col("value").alias("hours"),
        F.coalesce(F.element_at(iv, F.col("event_type")), F.lit("other")).alias("iv"),
    )


@query("b9_hours_to_bars", f"""SELECT event_id, greatest(1, CAST(trunc(hours / hpb) AS INT)) AS bars,
  CAST(trunc(hours / hpb) AS INT) AS bars_raw FROM ({HOURS})""")
def b9(spark, sf):
    return _hours(spark, sf).select(
        "event_id", fx.hours_to_bars("hours", "iv").alias("bars"),
        fx.hours_to_bars("hours", "iv", at_least_one=False).alias("bars_raw"),
    )


@query("b10_period_label", f"""SELECT event_id, CASE WHEN b * hpb < 24 THEN printf('%.1f bars (%.1fh)', b, b * hpb)
  ELSE printf('%.1f bars (%.1fd)', b, b * hpb / 24) END AS label
  FROM (SELECT *, floor(hours / 3) * 3 AS b FROM ({HOURS}))""")
def b10(spark, sf):
    return _hours(spark, sf).withColumn("b", F.floor(F.col("hours") / 3) * F.lit(3.0)).select(
        "event_id", fx.period_label("b", "iv").alias("label")
    )
