"""Joins (J1-J8), smoothing (F1-F3), volatility and stops (R1-R9), signals and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ACCOUNT, DAILY, HOURLY, SIGNALS, SMOOTHED, TICKS, TRADES, bars, bars_sql, daily_bars, indexed_sql,
    query, r, rounded, rs, signals_sql, smooth_sql, table, with_,
)
from catalog.backtests import FLAGSHIP, flagship
from tidemark.functions import columns as fx
from tidemark.operators import align, backtest as bt, metrics as mt, rolling
from tidemark.operators.series import chunk_window, drop_halo, lay_out, trailing, with_ordinal
from tidemark.plans.staging import stage
from tidemark.plans.strategy import Trend, add_atr, add_smoothed, add_true_range, trend_signals
from tidemark.schema import SERIES
from tidemark.sources.ticks import resample_bars

ID = ["symbol", "bar_idx"]


def smoothed(spark, sf, interval="1h"):
    return add_smoothed(bars(spark, sf, interval), FLAGSHIP)


def on_bars(d, back, **columns):
    """Evaluate bounded look-back columns chunk by chunk and return them with the bar id."""
    laid = lay_out(d, back=back)
    for name, c in columns.items():
        laid = laid.withColumn(name, c)
    return rounded(drop_halo(laid).select(*ID, *columns))


# --- joins and alignment ------------------------------------------------------------------------

B30 = f"{TICKS}, {bars_sql('30m', 'b30')}, {bars_sql('4h', 'b4')}"


@query("j1_asof_timeframes", with_(B30, f"""SELECT l.symbol, l.open_time, {r('l.close', 'close')},
  {r('coalesce(h.close, f.close)', 'close_4h')}, coalesce(h.trades, f.trades) AS trades_4h
  FROM b30 l ASOF LEFT JOIN b4 h ON l.symbol = h.symbol AND l.open_time >= h.open_time
  JOIN (SELECT symbol, arg_min(close, open_time) AS close, arg_min(trades, open_time) AS trades FROM b4 GROUP BY symbol) f
  ON f.symbol = l.symbol"""))
def j1(spark, sf):
    fine = bars(spark, sf, "30m")
    high = resample_bars(fine, "4h").select("symbol", "open_time", "close", "trades")
    return rounded(align.asof_join(fine.select("symbol", "open_time", "close"), high, "4h"))


# The higher side starts late, so the leading rows must take its first bar.
@query("j1_asof_before_first", with_(B30, f"""SELECT l.symbol, l.open_time, {r('coalesce(h.close, f.close)', 'close_4h')}
  FROM b30 l ASOF LEFT JOIN (FROM b4 WHERE open_time >= TIMESTAMP '2024-01-10') h ON l.symbol = h.symbol AND l.open_time >= h.open_time
  JOIN (SELECT symbol, arg_min(close, open_time) AS close FROM b4 WHERE open_time >= TIMESTAMP '2024-01-10' GROUP BY symbol) f
  ON f.symbol = l.symbol"""))
def j1_first(spark, sf):
    low = bars(spark, sf, "30m").select("symbol", "open_time")
    high = bars(spark, sf, "4h").where("open_time >= timestamp_ntz'2024-01-10 00:00:00'")
    return rounded(align.asof_join(low, high.select("symbol", "open_time", "close"), "4h"))


DRET = f"""{DAILY}, ret AS (SELECT symbol, open_time, bar_idx, n_bars, close,
  close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS ret FROM ib)"""


def daily_returns(spark, sf):
    d = with_ordinal(daily_bars(spark, sf))
    return mt.with_returns(d, "close").select(*SERIES, "open_time", "bar_idx", "n_bars", "close", "ret")


@query("j2_inner_join_returns", with_(DRET, f"""SELECT open_time, {r('a.ret', 'asia')}, {r('b.ret', 'europe')}
  FROM ret a JOIN ret b USING (open_time) WHERE a.symbol = 'ASIA' AND b.symbol = 'EUROPE'"""))
def j2(spark, sf):
    d = daily_returns(spark, sf)
    side = lambda s, n: d.where(F.col("symbol") == s).select("open_time", F.col("ret").alias(n))
    return rounded(align.join_on_time(side("ASIA", "asia"), side("EUROPE", "europe")))


@query("j3_align_intersection", with_(DRET, f"""SELECT symbol, open_time, {rs('ret')} FROM ret WHERE open_time IN
  (SELECT open_time FROM ret GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ret))"""))
def j3(spark, sf):
    return rounded(align.align_series(daily_returns(spark, sf)).select("symbol", "open_time", "ret"))


@query("j3_align_union", with_(DRET, f"""SELECT s.symbol, t.open_time, {rs('ret')} FROM (SELECT DISTINCT open_time FROM ret) t
  CROSS JOIN (SELECT DISTINCT symbol FROM ret) s LEFT JOIN ret USING (symbol, open_time)"""))
def j3_union(spark, sf):
    return rounded(align.align_series(daily_returns(spark, sf), "union").select("symbol", "open_time", "ret"))


# Only series of equal length may be paired by position: the common days, numbered anew.
COMMON = f"""{DRET}, common AS (SELECT symbol, open_time, ret, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS bar_idx FROM ret
  WHERE open_time IN (SELECT open_time FROM ret GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ret)))"""


def common_returns(spark, sf):
    return with_ordinal(align.align_series(stage(daily_returns(spark, sf))).drop("bar_idx", "n_bars"))


@query("j3_align_position", with_(COMMON, f"SELECT symbol, bar_idx, {rs('ret')} FROM common"))
def j3_position(spark, sf):
    return rounded(align.align_series(common_returns(spark, sf), "position").select("symbol", "bar_idx", "ret"))


@query("j4_lookup_default", f"""SELECT s_suppkey, coalesce(n_name, 'Unknown') AS sector FROM supplier
  LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey""")
def j4(spark, sf):
    even = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sector")
    )
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return align.lookup(s, even, "s_nationkey", "sector", "Unknown").select("s_suppkey", "sector")


@query("j8_asset_pairs", with_(DRET, f"""SELECT a.open_time, a.symbol AS sym_i, b.symbol AS sym_j, {r('a.ret', 'x')}, {r('b.ret', 'y')}
  FROM ret a JOIN ret b ON a.open_time = b.open_time AND a.symbol < b.symbol"""))
def j8(spark, sf):
    return rounded(align.pairs(daily_returns(spark, sf), "ret"))


# --- smoothing ----------------------------------------------------------------------------------

@query("f1_cutoff_from_period", """SELECT event_id, CASE WHEN p <= 0 THEN 1.0 ELSE round(least((n / p * s) / (n / 2), 1.0), 7) END AS cutoff
  FROM (SELECT event_id, (CAST(json_extract(props, '$.k') AS INT) - 5)::DOUBLE AS p, value + 1 AS n, user_id::DOUBLE / 20 AS s FROM events)""")
def f1(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", (F.get_json_object("props", "$.k").cast("double") - 5).alias("p"), (F.col("value") + 1).alias("n"),
        (F.col("user_id") / 20).alias("s"),
    )
    safe = F.when(F.col("p") > 0, F.col("p"))
    cut = F.coalesce(fx.cutoff_fraction(safe, F.col("n"), F.col("s")), F.lit(1.0))
    return e.select("event_id", F.round(cut, 7).alias("cutoff"))


@query("f2_dct_lowpass", with_(f"{HOURLY}, {smooth_sql(period='10', scale='1.7')}", f"SELECT symbol, bar_idx, {rs('smoothed')} FROM sm"))
def f2(spark, sf):
    return rounded(add_smoothed(bars(spark, sf), Trend(min_trend_bars=10, cutoff_scale=1.7)).select(*ID, "smoothed"))


@query("f3_smooth_price", with_(SMOOTHED, f"SELECT symbol, bar_idx, {rs('smoothed')} FROM sm"))
def f3(spark, sf):
    return rounded(smoothed(spark, sf).select(*ID, "smoothed"))


@query("f3_smooth_daily", with_(f"{DAILY}, {smooth_sql()}", f"SELECT symbol, bar_idx, {rs('smoothed')} FROM sm"))
def f3_daily(spark, sf):
    return rounded(add_smoothed(daily_bars(spark, sf), FLAGSHIP).select(*ID, "smoothed"))


# --- volatility and stops -----------------------------------------------------------------------

TR = f"""{HOURLY}, tr0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""


def ewm_sql(period: int, source: str = "tr0", name: str = "atr", x: str = "tr") -> str:
    a = f"(2.0::DOUBLE / ({period} + 1))"
    return f"""{name}_r AS (SELECT symbol, bar_idx, {x} AS y FROM {source} WHERE bar_idx = 0 UNION ALL
    SELECT s.symbol, s.bar_idx, {a} * s.{x} + (1 - {a}) * p.y FROM {name}_r p JOIN {source} s
    ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx + 1),
  {name} AS (SELECT s.*, e.y AS {name} FROM {source} s JOIN {name}_r e USING (symbol, bar_idx))"""


ATR = f"{TR}, {ewm_sql(14)}"


@query("r1_true_range", with_(TR, f"SELECT symbol, bar_idx, {rs('tr')} FROM tr0"))
def r1(spark, sf):
    return rounded(add_true_range(bars(spark, sf)).select(*ID, "tr"))


@query("r2_ewm_atr", with_(ATR, f"SELECT symbol, bar_idx, {rs('atr')} FROM atr"))
def r2(spark, sf):
    return rounded(add_atr(bars(spark, sf), 14).select(*ID, "atr"))


@query("r2_ewm_atr_slow", with_(f"{TR}, {ewm_sql(400)}", f"SELECT symbol, bar_idx, {rs('atr')} FROM atr"))
def r2_slow(spark, sf):
    return rounded(add_atr(bars(spark, sf), 400).select(*ID, "atr"))


@query("r3_residual_sigma", with_(SMOOTHED, f"""SELECT symbol, bar_idx, {r('''coalesce(stddev_samp(close - smoothed)
  OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING), 0)''', 'sigma')} FROM sm"""))
def r3(spark, sf):
    return on_bars(smoothed(spark, sf), 19, sigma=fx.residual_sigma("close", "smoothed", trailing(SERIES, 20)))


QUANT = """quantile_cont(abs(close - smoothed), 0.95) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING)"""


@query("r4_residual_quantile", with_(SMOOTHED, f"SELECT symbol, bar_idx, {r(QUANT, 'q')} FROM sm"))
def r4(spark, sf):
    return on_bars(smoothed(spark, sf), 19, q=fx.residual_quantile("close", "smoothed", trailing(SERIES, 20)))


BANDS = "long_stop long_profit short_stop short_profit"


@query("r5_atr_stops", with_(f"""{ATR}, bands AS (SELECT symbol, bar_idx, close - 2 * atr AS long_stop, close + 3 * atr AS long_profit,
  close + 2 * atr AS short_stop, close - 3 * atr AS short_profit FROM atr)""", f"SELECT symbol, bar_idx, {rs(BANDS)} FROM bands"))
def r5(spark, sf):
    d = add_atr(bars(spark, sf), 14)
    return rounded(d.select(*ID, *[c.alias(n) for n, c in fx.stop_bands("close", "atr", 2.0, 3.0).items()]))


@query("r6_residual_stops", with_(f"""{SMOOTHED}, bands AS (SELECT symbol, bar_idx, smoothed - 2 * q AS long_stop, smoothed + 3 * q AS long_profit,
  smoothed + 2 * q AS short_stop, smoothed - 3 * q AS short_profit FROM (SELECT *, {QUANT} AS q FROM sm))""",
  f"SELECT symbol, bar_idx, {rs(BANDS)} FROM bands"))
def r6(spark, sf):
    return rounded(trend_signals(bars(spark, sf), Trend(stop="quantile")).select(*ID, *BANDS.split()))


@query("r7_trailing_stop", with_(TRADES, f"""SELECT t.symbol, t.entry_idx, s.bar_idx, {r('''max(s.smoothed - 2 * s.width) OVER
  (PARTITION BY t.symbol, t.entry_idx ORDER BY s.bar_idx)''', 'trailing')} FROM tr t JOIN sig s ON s.symbol = t.symbol
  AND s.bar_idx >= t.entry_idx AND s.bar_idx < t.exit_idx"""))
def r7(spark, sf):
    pos, trades, _ = flagship(spark, sf)
    entries = trades.select(*SERIES, "entry_idx", F.col("exit_idx").alias("end_idx"), "direction")
    return rounded(rolling.trailing_stop(pos, entries).drop("interval"))


@query("r8_drawdown_curve", with_(f"{ACCOUNT}, c AS (SELECT symbol, bar_idx, equity, max(equity) OVER (PARTITION BY symbol ORDER BY bar_idx) AS peak FROM acc)",
  f"SELECT symbol, bar_idx, {rs('equity peak')}, {r('(equity - peak) / peak', 'drawdown_pct')} FROM c"))
def r8(spark, sf):
    pos = flagship(spark, sf)[0].select(*SERIES, "bar_idx", "equity")
    return rounded(mt.with_drawdown(pos).select(*ID, "equity", "peak", "drawdown_pct"))


@query("r9_rolling_correlation", with_(f"""{DRET}, p AS (SELECT a.open_time, a.symbol AS sym_i, b.symbol AS sym_j, a.ret AS x, b.ret AS y
  FROM ret a JOIN ret b ON a.open_time = b.open_time AND a.symbol < b.symbol)""", f"""SELECT sym_i, sym_j, open_time,
  {r('CASE WHEN count(x + y) OVER w >= 60 THEN corr(x, y) OVER w END', 'corr', 6)} FROM p
  WINDOW w AS (PARTITION BY sym_i, sym_j ORDER BY open_time ROWS 59 PRECEDING)"""))
def r9(spark, sf):
    return rounded(rolling.rolling_correlation(daily_returns(spark, sf)), 6)


# --- signals ------------------------------------------------------------------------------------

LAGS = f"""{SMOOTHED}, lg AS (SELECT *, lag(close) OVER w AS pc, lag(smoothed) OVER w AS ps, smoothed - lag(smoothed, 3) OVER w AS s3,
  smoothed - lag(smoothed) OVER w AS s1 FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""


@query("s1_slope", with_(LAGS, f"SELECT symbol, bar_idx, {r('s3', 'slope')} FROM lg"))
def s1(spark, sf):
    return on_bars(smoothed(spark, sf), 3, slope=fx.slope("smoothed", 3, chunk_window()))


@query("s2_cross_above", with_(LAGS, "SELECT symbol, bar_idx, coalesce(pc <= ps AND close > smoothed, false) AS hit FROM lg"))
def s2(spark, sf):
    return on_bars(smoothed(spark, sf), 1, hit=fx.crosses_above("close", "smoothed", chunk_window()))


@query("s3_cross_below", with_(LAGS, "SELECT symbol, bar_idx, coalesce(pc >= ps AND close < smoothed, false) AS hit FROM lg"))
def s3(spark, sf):
    return on_bars(smoothed(spark, sf), 1, hit=fx.crosses_below("close", "smoothed", chunk_window()))


@query("s4_trend_following", with_(LAGS, """SELECT symbol, bar_idx, coalesce(pc <= ps AND close > smoothed AND s3 > 0.05 AND high - low >= 5, false) AS entry,
  coalesce(pc >= ps AND close < smoothed, false) AS leave FROM lg"""))
def s4(spark, sf):
    d = smoothed(spark, sf).withColumn("vol", F.col("high") - F.col("low"))
    entry = fx.trend_entry("close", "smoothed", chunk_window(), fx.slope("smoothed", 3, chunk_window()), 0.05, 5.0, "vol")
    return on_bars(d, 3, entry=entry, leave=fx.crosses_below("close", "smoothed", chunk_window()))


@query("s5_signals_with_stops", with_(SIGNALS, "SELECT symbol, bar_idx, signal FROM sig"))
def s5(spark, sf):
    return trend_signals(bars(spark, sf), FLAGSHIP).select(*ID, "signal")


@query("s5_signals_tight_stop", with_(f"{SMOOTHED}, {signals_sql(k='1')}", "SELECT symbol, bar_idx, signal FROM sig"))
def s5_tight(spark, sf):
    return trend_signals(bars(spark, sf), Trend(k_stop=1.0)).select(*ID, "signal")


@query("s6_entry_spacing", with_(f"""{SIGNALS}, en AS (SELECT symbol, bar_idx FROM sig WHERE signal = 1),
  kept AS (SELECT symbol, min(bar_idx) AS bar_idx FROM en GROUP BY symbol UNION ALL
    SELECT k.symbol, (SELECT min(e.bar_idx) FROM en e WHERE e.symbol = k.symbol AND e.bar_idx - k.bar_idx >= 12) FROM kept k
    WHERE EXISTS (SELECT 1 FROM en e WHERE e.symbol = k.symbol AND e.bar_idx - k.bar_idx >= 12))""",
  """SELECT s.symbol, s.bar_idx, CASE WHEN s.signal = 1 AND k.bar_idx IS NULL THEN 0 ELSE s.signal END AS spaced
  FROM sig s LEFT JOIN kept k USING (symbol, bar_idx)"""))
def s6(spark, sf):
    return rolling.space_entries(trend_signals(bars(spark, sf), FLAGSHIP), 12).select(*ID, "spaced")


DIRECTION = """CASE WHEN close > smoothed AND coalesce(smoothed - lag(smoothed, {k}) OVER w, 0) > 0 THEN 1
  WHEN close < smoothed AND coalesce(smoothed - lag(smoothed, {k}) OVER w, 0) < 0 THEN -1 ELSE 0 END"""


@query("s7_trend_direction", with_(SMOOTHED, f"""SELECT symbol, bar_idx, {DIRECTION.format(k=2)} AS trend FROM sm
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)"""))
def s7(spark, sf):
    return on_bars(smoothed(spark, sf), 2, trend=fx.trend_direction("close", "smoothed", 2, chunk_window()))


def _frame(iv: str, n: str) -> str:
    return f"""{bars_sql(iv, 'b' + n)}, {indexed_sql('b' + n, 'i' + n)}, {smooth_sql(source='i' + n, name='s' + n)},
  t{n} AS (SELECT *, {DIRECTION.format(k=2)} AS trend FROM s{n} WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""


MTF = f"""{TICKS}, {_frame('30m', 'a')}, {_frame('1h', 'b')}, {_frame('4h', 'c')},
  mtf AS (SELECT l.symbol, l.bar_idx, l.open_time, l.trend AS t30, coalesce(b.trend, fb.trend) AS t1h, coalesce(c.trend, fc.trend) AS t4h
  FROM ta l ASOF LEFT JOIN tb b ON l.symbol = b.symbol AND l.open_time >= b.open_time
  ASOF LEFT JOIN tc c ON l.symbol = c.symbol AND l.open_time >= c.open_time
  JOIN (SELECT symbol, trend FROM tb WHERE bar_idx = 0) fb ON fb.symbol = l.symbol
  JOIN (SELECT symbol, trend FROM tc WHERE bar_idx = 0) fc ON fc.symbol = l.symbol),
  vote AS (SELECT *, (t30 = 1)::INT + (t1h = 1)::INT + (t4h = 1)::INT AS up, (t30 = -1)::INT + (t1h = -1)::INT + (t4h = -1)::INT AS dn FROM mtf)"""


def trend_of(d):
    laid = lay_out(add_smoothed(d, FLAGSHIP), back=2)
    return drop_halo(laid.withColumn("trend", fx.trend_direction("close", "smoothed", 2, chunk_window())))


def mtf(spark, sf):
    fine = bars(spark, sf, "30m")
    low = trend_of(fine)
    out = low.select("symbol", "bar_idx", "n_bars", "open_time", "open", "high", "low", "close", "smoothed", F.col("trend").alias("trend_30m"))
    for iv in ("1h", "4h"):
        # longer bars come from the 30-minute ones: the ticks are read once
        out = align.asof_join(out, trend_of(stage(resample_bars(fine, iv))).select("symbol", "open_time", "trend"), iv)
    return out.withColumn("interval", F.lit("30m"))


TRENDS = ["trend_30m", "trend_1h", "trend_4h"]


@query("s8_timeframe_vote", with_(MTF, """SELECT symbol, bar_idx, t30 AS trend_30m, t1h AS trend_1h, t4h AS trend_4h,
  up = 3 AS all_long, dn = 3 AS all_short, up >= 2 AS two_long, dn >= 2 AS two_short FROM vote"""))
def s8(spark, sf):
    return mtf(spark, sf).select(
        *ID, *TRENDS, fx.timeframes_agree(TRENDS, 1).alias("all_long"), fx.timeframes_agree(TRENDS, -1).alias("all_short"),
        fx.timeframes_agree(TRENDS, 1, False).alias("two_long"), fx.timeframes_agree(TRENDS, -1, False).alias("two_short"),
    )


LONG_SHORT = f"""{MTF}, {ewm_sql(14, source='(SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM sa WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))', name='atr')},
  raw AS (SELECT *, CASE WHEN (pc >= ps AND close < smoothed) OR close < close - 2 * atr THEN -1 WHEN en THEN 1 ELSE 0 END AS long_raw,
    CASE WHEN (pc >= ps AND close < smoothed) OR close < close + 2 * atr THEN -1 WHEN en THEN 1 ELSE 0 END AS short_raw FROM (
    SELECT *, pc <= ps AND close > smoothed AND rise > 0 AS en FROM (SELECT *, lag(close) OVER w AS pc, lag(smoothed) OVER w AS ps,
    smoothed - lag(smoothed, 2) OVER w AS rise FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)))),
  ls AS (SELECT r.*, CASE WHEN long_raw = 1 AND up < 2 THEN 0 ELSE long_raw END AS long_signal,
    CASE WHEN short_raw = -1 AND dn < 2 THEN 0 ELSE short_raw END AS short_signal FROM raw r JOIN vote USING (symbol, bar_idx)),
  sls AS (SELECT *, CASE short_signal WHEN 1 THEN 2 WHEN -1 THEN -2 ELSE long_signal END AS signal FROM ls)"""


def long_short(spark, sf):
    """Long and short passes over ATR stops, each filtered by the time-frame vote, then merged."""
    d = stage(mtf(spark, sf))
    d = lay_out(add_atr(d, 14), back=2)
    rise = fx.slope("smoothed", 2, chunk_window())
    entry = fx.trend_entry("close", "smoothed", chunk_window(), rise)
    below = fx.crosses_below("close", "smoothed", chunk_window())
    passes = {
        "long": (F.col("close") - 2.0 * F.col("atr"), 1),
        "short": (F.col("close") + 2.0 * F.col("atr"), -1),
    }
    for name, (stop, way) in passes.items():
        code = fx.signal_code(entry, fx.any_of(below, F.col("close") < stop))
        aligned = fx.timeframes_agree(TRENDS, way, False)
        d = d.withColumn(f"{name}_raw", code).withColumn(f"{name}_signal", fx.keep_aligned(f"{name}_raw", aligned, way))
    d = d.withColumn("signal", fx.merge_directions("long_signal", "short_signal"))
    return drop_halo(d).drop("chunk")


@query("s9_timeframe_filter", with_(LONG_SHORT, "SELECT symbol, bar_idx, long_signal, short_signal FROM ls"))
def s9(spark, sf):
    return long_short(spark, sf).select(*ID, "long_signal", "short_signal")


@query("s10_long_short_merge", with_(LONG_SHORT, "SELECT symbol, bar_idx, signal FROM sls"))
def s10(spark, sf):
    return long_short(spark, sf).select(*ID, "signal")


@query("s11_slope_reversal", with_(f"""{SMOOTHED}, sl AS (SELECT symbol, bar_idx, coalesce(smoothed - lag(smoothed, 2) OVER w, 0) AS s,
  coalesce(lag(smoothed) OVER w - lag(smoothed, 3) OVER w, 0) AS p FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))""",
  "SELECT symbol, bar_idx, abs(s) > 0.1 AND abs(p) > 0.1 AND sign(s) * sign(p) < 0 AS hit FROM sl"))
def s11(spark, sf):
    return on_bars(smoothed(spark, sf), 3, hit=fx.slope_reverses("smoothed", 2, 0.1, chunk_window()))


@query("s12_any_exit", with_(LAGS, """SELECT symbol, bar_idx, coalesce(pc >= ps AND close < smoothed, false) OR coalesce(s3 < -1, false)
  OR close < 1 AS hit FROM lg"""))
def s12(spark, sf):
    conditions = [fx.crosses_below("close", "smoothed", chunk_window()), fx.slope("smoothed", 3, chunk_window()) < -1, F.col("close") < 1]
    return on_bars(smoothed(spark, sf), 3, hit=fx.any_of(*conditions))


@query("s13_time_exit", with_(TRADES, "SELECT symbol, entry_idx, entry_idx >= 0 AND exit_idx - entry_idx >= 2 AS hit FROM tr"))
def s13(spark, sf):
    return flagship(spark, sf)[1].select("symbol", "entry_idx", fx.held_too_long("entry_idx", "exit_idx", 2).alias("hit"))


STEPS = [(0.02, 0.3), (0.05, 0.3), (0.5, 0.4)]
LEVELS = f"""{TRADES}, lv AS (SELECT t.*, l.level, l.share, t.entry_price * (1 + l.pct) AS level_price FROM tr t CROSS JOIN
  (VALUES (0, 0.02::DOUBLE, 0.3::DOUBLE), (1, 0.05::DOUBLE, 0.3::DOUBLE), (2, 0.5::DOUBLE, 0.4::DOUBLE)) l(level, pct, share))"""


@query("s14_profit_levels", with_(LEVELS, f"SELECT symbol, entry_idx, level, share, round(level_price, 8) AS level_price FROM lv"))
def s14(spark, sf):
    levels = bt.profit_levels(flagship(spark, sf)[1], STEPS)
    return levels.select("symbol", "entry_idx", "level", "share", F.round("level_price", 8).alias("level_price"))


@query("s15_profit_hits", with_(LEVELS, f"""SELECT lv.symbol, lv.entry_idx, lv.level, round(level_price, 8) AS level_price, min(b.bar_idx) AS hit_idx
  FROM lv JOIN ib b ON b.symbol = lv.symbol AND b.bar_idx >= lv.entry_idx AND b.bar_idx < lv.exit_idx AND b.high >= lv.level_price GROUP BY ALL"""))
def s15(spark, sf):
    pos, trades, _ = flagship(spark, sf)
    hits = bt.profit_hits(bt.profit_levels(trades, STEPS), pos)
    return hits.select("symbol", "entry_idx", "level", F.round("level_price", 8).alias("level_price"), "hit_idx")


# Sizes for every order line: capital, entry, stop and volatility taken from its columns.
SIZES = """z AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS cap,
  l_extendedprice / l_quantity AS px, CASE WHEN l_linenumber = 1 THEN l_extendedprice / l_quantity
  ELSE l_extendedprice / l_quantity * (0.9::DOUBLE + l_tax) END AS stop, l_quantity AS vol, l_discount AS disc FROM lineitem)"""


def sizes(spark, sf):
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice")).alias("cap"),
        px.alias("px"), F.when(F.col("l_linenumber") == 1, px).otherwise(px * (0.9 + F.col("l_tax"))).alias("stop"),
        F.col("l_quantity").alias("vol"), F.col("l_discount").alias("disc"),
    )


@query("s16_volatility_size", with_(SIZES, f"""SELECT l_orderkey, l_linenumber, {rs('atr_size sigma_size')} FROM (SELECT *,
  CASE WHEN cap > 0 AND px > 0 AND vol > 0 THEN least(cap * 0.02 / risk, cap * 0.03 / risk, cap / px) ELSE 0 END AS atr_size,
  CASE WHEN cap > 0 AND px > 0 AND vol > 0 THEN least(cap * 0.02 / vol, cap * 0.03 / risk, cap / px) ELSE 0 END AS sigma_size
  FROM (SELECT *, CASE WHEN abs(px - stop) > 0 THEN abs(px - stop) ELSE vol END AS risk FROM z))"""))
def s16(spark, sf):
    z = sizes(spark, sf)
    return rounded(z.select(
        "l_orderkey", "l_linenumber", fx.volatility_size("cap", "px", "stop", "vol", 0.02, 0.03).alias("atr_size"),
        fx.volatility_size("cap", "px", "stop", "vol", 0.02, 0.03, "sigma").alias("sigma_size"),
    ))


@query("s17_fixed_risk_size", with_(SIZES, f"""SELECT l_orderkey, l_linenumber, {r('''CASE WHEN cap > 0 AND px > 0 AND abs(px - stop) > 0
  THEN least(cap * 0.01 / abs(px - stop), cap / px) ELSE 0 END''', 'size')} FROM z"""))
def s17(spark, sf):
    return rounded(sizes(spark, sf).select("l_orderkey", "l_linenumber", fx.fixed_risk_size("cap", "px", "stop", 0.01).alias("size")))


@query("s18_pyramid_size", with_(SIZES, f"""SELECT l_orderkey, l_linenumber, {r('''CASE WHEN vol <= 0 OR now < vol THEN 0
  WHEN CAST(trunc(ln(now / vol) / ln(1.5::DOUBLE)) AS INT) + 1 >= 3 THEN 0 ELSE vol * 0.5 END''', 'size')}
  FROM (SELECT *, vol * (0.9 + disc * 20) AS now FROM z)"""))
def s18(spark, sf):
    z = sizes(spark, sf).withColumn("now", F.col("vol") * (0.9 + F.col("disc") * 20))
    return rounded(z.select("l_orderkey", "l_linenumber", fx.pyramid_size("vol", "now", 3, 0.5).alias("size")))


@query("s19_pyramid_condition", with_(SIZES, """SELECT l_orderkey, l_linenumber, px > 0 AND (stop - px) / px >= 0.015 AS long_ok,
  px > 0 AND (stop - px) / px <= -0.015 AS short_ok FROM z"""))
def s19(spark, sf):
    return sizes(spark, sf).select(
        "l_orderkey", "l_linenumber", fx.pyramid_allowed("px", "stop", 0.015, 1).alias("long_ok"),
        fx.pyramid_allowed("px", "stop", 0.015, -1).alias("short_ok"),
    )
