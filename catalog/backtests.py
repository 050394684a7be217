"""Backtests and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ACCOUNT, HOURLY, METRIC_NAMES, SIGNALS, TRADES, bars, indexed, metrics_sql, query, r, replay_sql, rounded, rs, with_,
)
from tidemark.operators import backtest as bt, metrics as mt
from tidemark.plans.staging import stage
from tidemark.plans.strategy import Trend, run_trend, trend_signals

FLAGSHIP = Trend()
MET = f"{TRADES}, {metrics_sql()}"


def flagship(spark, sf):
    return run_trend(bars(spark, sf), FLAGSHIP)


METRIC_SELECT = f"SELECT symbol, '1h' AS \"interval\", n_trades, n_wins, n_losses, {rs(METRIC_NAMES)} FROM met"


@query("e5_metric_summary", with_(MET, METRIC_SELECT))
def e5(spark, sf):
    return rounded(flagship(spark, sf)[2])


TRADE_DOUBLES = "entry_price exit_price size pnl pnl_pct mae mfe mae_pct mfe_pct fees"
TRADE_SELECT = f"symbol, entry_idx, exit_idx, entry_time, exit_time, bars_held, {rs(TRADE_DOUBLES)}"


def trade_view(t):
    return rounded(t.select("symbol", "entry_idx", "exit_idx", "entry_time", "exit_time", "bars_held", *TRADE_DOUBLES.split()))


@query("e2_equity_curve", with_(ACCOUNT, f"SELECT symbol, bar_idx, (units > 0)::INT AS pos, {rs('equity')} FROM acc"))
def e2(spark, sf):
    pos = bt.positions(stage(trend_signals(bars(spark, sf), FLAGSHIP)))
    return rounded(pos.select("symbol", "bar_idx", "pos", "equity"))


HALF = f"{SIGNALS}, {replay_sql(fraction='0.6')}"


@query("e2_partial_fraction", with_(HALF, f"SELECT symbol, bar_idx, (units > 0)::INT AS pos, {rs('equity')} FROM acc"))
def e2_fraction(spark, sf):
    pos = bt.positions(stage(trend_signals(bars(spark, sf), FLAGSHIP)), account=bt.Account(fraction=0.6))
    return rounded(pos.select("symbol", "bar_idx", "pos", "equity"))


@query("e3_trade_record", with_(TRADES, f"SELECT {TRADE_SELECT} FROM tr"))
def e3(spark, sf):
    return trade_view(flagship(spark, sf)[1])


@query("a16_trade_log", with_(TRADES, f"SELECT {TRADE_SELECT}, 1 AS direction, 'signal' AS exit_reason, 0 AS n_partials FROM tr"))
def a16(spark, sf):
    t = flagship(spark, sf)[1].withColumn("n_partials", F.coalesce(F.size("partial_exits"), F.lit(0)))
    t = t.withColumn("n_partials", F.greatest("n_partials", F.lit(0)))
    cols = ["symbol", "entry_idx", "exit_idx", "entry_time", "exit_time", "bars_held", *TRADE_DOUBLES.split(), "direction", "exit_reason", "n_partials"]
    return rounded(t.select(*cols))


@query("e1_mae_mfe", with_(TRADES, f"SELECT symbol, entry_idx, {rs('mae mfe')} FROM tr"))
def e1(spark, sf):
    pos, trades, _ = flagship(spark, sf)
    return rounded(bt.mae_mfe(trades.drop("mae", "mfe"), pos).select("symbol", "entry_idx", "mae", "mfe"))


@query("j7_trade_bar_range", with_(TRADES, f"""SELECT t.symbol, t.entry_idx, {r('max(b.high)', 'hi')}, {r('min(b.low)', 'lo')}
  FROM tr t JOIN ib b ON b.symbol = t.symbol AND b.bar_idx >= t.entry_idx AND b.bar_idx < t.exit_idx GROUP BY ALL"""))
def j7(spark, sf):
    pos, trades, _ = flagship(spark, sf)
    return rounded(bt.excursions(trades, pos).drop("interval"))


@query("e6_max_drawdown", with_(MET, f"SELECT symbol, {rs('max_drawdown max_drawdown_pct')} FROM met"))
def e6(spark, sf):
    pos = mt.with_drawdown(flagship(spark, sf)[0].select("symbol", "interval", "bar_idx", "equity"))
    return rounded(pos.groupBy("symbol").agg(*[c.alias(n) for n, c in mt.max_drawdown_columns().items()]))


DAYS = """dq AS (SELECT symbol, bar_idx, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS ret FROM ib)"""


@query("e7_sharpe", with_(f"{HOURLY}, {DAYS}", f"""SELECT symbol, {r('''CASE WHEN count(ret) = 0 OR stddev_samp(ret) < 1e-10 THEN 0
  ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END''', 'sharpe')} FROM dq GROUP BY symbol"""))
def e7(spark, sf):
    d = mt.with_returns(indexed(spark, sf), "close")
    return rounded(d.groupBy("symbol").agg(mt.sharpe("ret", 252).alias("sharpe")))


@query("e8_sortino", with_(f"{HOURLY}, {DAYS}", f"""SELECT symbol, {r('''CASE WHEN count(*) FILTER (WHERE ret < 0.01) = 0 OR
  stddev_samp(ret) FILTER (WHERE ret < 0.01) = 0 THEN 'inf'::DOUBLE
  ELSE (avg(ret) - 0.01) / (stddev_samp(ret) FILTER (WHERE ret < 0.01)) * sqrt(252) END''', 'sortino')} FROM dq GROUP BY symbol"""))
def e8(spark, sf):
    d = mt.with_returns(indexed(spark, sf), "close")
    return rounded(d.groupBy("symbol").agg(mt.sortino("ret", 252, 0.01).alias("sortino")))


# --- shorts, stops, time exits, sizing ----------------------------------------------------------

def full_sql(size: str, maxb: str = "1000000000", shorts: str = "true") -> str:
    """Sequential account with every exit rule; a row is the state before the bar's signal acts."""
    enter = f"(a.units = 0 AND (s.sig4 = 1 OR ({shorts} AND s.sig4 = 2)))"
    way = "(CASE WHEN s.sig4 = 1 THEN 1 ELSE -1 END)"
    fill = f"(s.nopen * (1 + {way} * 0.0005::DOUBLE))"
    z = "(" + size.replace("CASH", "a.cash").replace("FILL", fill) + ")"
    ok = f"({enter} AND {z} > 0 AND {z} * {fill} * 1.001::DOUBLE <= a.cash + 1e-10)"
    stopped = "coalesce(CASE WHEN a.dir = 1 THEN s.close < s.stop ELSE s.close > s.stop END, false)"
    late = f"(s.bar_idx - a.ei >= {maxb})"
    leave = f"(a.units > 0 AND ({late} OR {stopped} OR (a.dir = 1 AND s.sig4 = -1) OR (a.dir = -1 AND s.sig4 = -2)))"
    out = "(s.nopen * (1 - a.dir * 0.0005::DOUBLE))"
    back = f"""CASE WHEN a.dir = 1 THEN a.units * {out} * 0.999::DOUBLE
      ELSE 2 * a.units * a.ep - a.units * {out} - 0.001::DOUBLE * (a.units * {out} + a.units * a.ep) END"""
    return f"""four AS (SELECT *, lead(open) OVER w AS nopen, lead(open_time) OVER w AS ntime, smoothed - 0.5 * width AS stop,
    CASE WHEN pc <= ps AND close > smoothed AND rise > 0 THEN 1 WHEN pc >= ps AND close < smoothed AND rise < 0 THEN 2
      WHEN pc >= ps AND close < smoothed THEN -1 WHEN pc <= ps AND close > smoothed THEN -2 ELSE 0 END AS sig4
    FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
  fa AS (SELECT symbol, 0::BIGINT AS bar_idx, 10000.0::DOUBLE AS cash, 0.0::DOUBLE AS units, 0 AS dir, 0.0::DOUBLE AS ep, -1::BIGINT AS ei,
    NULL::TIMESTAMP AS et, 0.0::DOUBLE AS xu, 0.0::DOUBLE AS xp, NULL::VARCHAR AS why, NULL::TIMESTAMP AS xt, 0 AS xd FROM four WHERE bar_idx = 0
  UNION ALL SELECT s.symbol, s.bar_idx + 1,
    CASE WHEN {leave} THEN a.cash + ({back}) WHEN {ok} THEN a.cash - {z} * {fill} * 1.001::DOUBLE ELSE a.cash END,
    CASE WHEN {leave} THEN 0 WHEN {ok} THEN {z} ELSE a.units END, CASE WHEN {leave} THEN 0 WHEN {ok} THEN {way} ELSE a.dir END,
    CASE WHEN {ok} THEN {fill} ELSE a.ep END, CASE WHEN {ok} THEN s.bar_idx + 1 ELSE a.ei END, CASE WHEN {ok} THEN s.ntime ELSE a.et END,
    CASE WHEN {leave} THEN a.units ELSE 0 END, CASE WHEN {leave} THEN {out} ELSE 0 END,
    CASE WHEN {stopped} THEN 'stop' WHEN {late} THEN 'time' ELSE 'signal' END, s.ntime, a.dir
    FROM fa a JOIN four s ON s.symbol = a.symbol AND s.bar_idx = a.bar_idx WHERE s.nopen IS NOT NULL),
  fe AS (SELECT symbol, bar_idx, cash + units * close AS equity FROM fa JOIN ib USING (symbol, bar_idx)),
  fh AS (SELECT f.symbol, f.bar_idx AS exit_idx, max(b.high) AS hi, min(b.low) AS lo FROM fa f JOIN ib b ON b.symbol = f.symbol
    AND b.bar_idx >= f.ei AND b.bar_idx < f.bar_idx WHERE f.xu > 0 GROUP BY ALL),
  ft AS (SELECT f.symbol, f.ei AS entry_idx, f.bar_idx AS exit_idx, f.et AS entry_time, f.xt AS exit_time, f.bar_idx - f.ei AS bars_held, f.xd AS direction,
    f.why AS exit_reason, f.ep AS entry_price, f.xp AS exit_price, f.xu AS size,
    f.xd * (f.xu * f.xp - f.xu * f.ep) - 0.001 * (f.xu * f.xp + f.xu * f.ep) AS pnl, 0.001 * (f.xu * f.xp + f.xu * f.ep) AS fees,
    CASE WHEN f.xd = 1 THEN f.ep - h.lo ELSE h.hi - f.ep END AS mae
    FROM fa f JOIN fh h ON h.symbol = f.symbol AND h.exit_idx = f.bar_idx WHERE f.xu > 0)"""


FULL = "CASH / (FILL * 1.001::DOUBLE)"
CAPPED = "least(0.02 * CASH / nullif(abs(FILL - s.stop), 0), CASH / FILL)"
FT = f"symbol, entry_idx, exit_idx, entry_time, exit_time, bars_held, direction, exit_reason, {rs('entry_price exit_price size pnl fees mae')}"


def four_codes(spark, sf, atr=False):
    """Long and short codes and half-width stops from the flagship's smooth line."""
    from tidemark.functions import columns as fx
    from tidemark.operators.series import chunk_window, drop_halo, lay_out
    from tidemark.plans.strategy import add_atr

    d = trend_signals(bars(spark, sf), FLAGSHIP).drop("signal", "sig1", "chunk")
    d = stage(add_atr(d, 14) if atr else d)
    w = chunk_window()
    up, down = fx.crosses_above("close", "smoothed", w), fx.crosses_below("close", "smoothed", w)
    rise = fx.slope("smoothed", 1, w)
    code = (
        F.when(up & fx.holds(rise > 0), 1).when(down & fx.holds(rise < 0), 2).when(down, -1).when(up, -2).otherwise(0)
    )
    laid = drop_halo(lay_out(d, back=1).withColumn("signal", code)).drop("chunk")
    return stage(laid.withColumn("stop", F.col("smoothed") - 0.5 * F.col("width")))


def four_trades(t):
    return rounded(t.select("symbol", "entry_idx", "exit_idx", "entry_time", "exit_time", "bars_held", "direction", "exit_reason",
                            "entry_price", "exit_price", "size", "pnl", "fees", "mae"))


FULL_RULES = f"{SIGNALS}, {full_sql(FULL, '6')}"
RULES = bt.Account(shorts=True, max_bars=6)


@query("e4_enhanced_trades", with_(FULL_RULES, f"SELECT {FT} FROM ft"))
def e4(spark, sf):
    return four_trades(bt.replay(four_codes(spark, sf), account=RULES)[1])


@query("e4_enhanced_equity", with_(FULL_RULES, f"SELECT symbol, bar_idx, {rs('equity')} FROM fe"))
def e4_equity(spark, sf):
    return rounded(bt.replay(four_codes(spark, sf), account=RULES)[0].select("symbol", "bar_idx", "equity"))


@query("e4_fixed_risk_trades", with_(f"{SIGNALS}, {full_sql(f'coalesce({CAPPED}, 0)')}", f"SELECT {FT} FROM ft"))
def e4_risk(spark, sf):
    return four_trades(bt.replay(four_codes(spark, sf), account=bt.Account(shorts=True, sizing="fixed_risk"))[1])


@query("e4_volatility_trades", with_(f"{SIGNALS}, {full_sql('(CASE WHEN s.atr > 0 AND CASH > 0 THEN least(0.02 * CASH / CASE WHEN abs(FILL - s.stop) > 0 THEN abs(FILL - s.stop) ELSE s.atr END, CASH / FILL) ELSE 0 END)').replace('FROM sig WINDOW', 'FROM sig JOIN (SELECT symbol, bar_idx, atr FROM atr) USING (symbol, bar_idx) WINDOW')}".replace(
    "four AS (", "tr0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)), "
    "atr_r AS (SELECT symbol, bar_idx, tr AS atr FROM tr0 WHERE bar_idx = 0 UNION ALL SELECT s.symbol, s.bar_idx, s.tr * 2 / 15.0::DOUBLE + p.atr * 13 / 15.0::DOUBLE "
    "FROM atr_r p JOIN tr0 s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx + 1), atr AS (SELECT * FROM atr_r), four AS (", 1), f"SELECT {FT} FROM ft"))
def e4_vol(spark, sf):
    return four_trades(bt.replay(four_codes(spark, sf, atr=True), account=bt.Account(shorts=True, sizing="volatility"))[1])


@query("e4_fixed_units_trades", with_(f"{SIGNALS}, {full_sql('(CASH * 0 + 100)', shorts='false')}", f"SELECT {FT} FROM ft"))
def e4_units(spark, sf):
    return four_trades(bt.replay(four_codes(spark, sf), account=bt.Account(mode="fixed", fraction=100.0))[1])


@query("e9_exit_reasons", with_(FULL_RULES, "SELECT symbol, exit_reason, count(*) AS n FROM ft GROUP BY ALL"))
def e9(spark, sf):
    return mt.exit_reasons(bt.replay(four_codes(spark, sf), account=RULES)[1], ["symbol"])
