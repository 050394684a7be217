"""Strategy plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HOURLY, bars, metrics_sql, query, r, replay_sql, rounded, trades_sql, with_
from tidemark.operators.series import drop_halo, lay_out, trailing
from tidemark.plans.plugins import backtest_rule, with_pandas_rule, with_rule
from tidemark.schema import SERIES

MA = f"""{HOURLY}, ma AS (SELECT *, CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS signal FROM (
  SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 9 PRECEDING) AS m FROM ib)),
  sig AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY bar_idx) AS sig1 FROM ma)"""


def above_average(d, rows=10):
    laid = lay_out(d, back=rows - 1)
    laid = drop_halo(laid.withColumn("_m", F.avg("close").over(trailing(SERIES, rows)))).drop("chunk")
    side = F.when(F.col("close") > F.col("_m"), 1).when(F.col("close") < F.col("_m"), -1).otherwise(0)
    return laid.withColumn("signal", side).drop("_m")


def above_average_pandas(pdf, rows=10):
    mean = pdf["close"].rolling(rows, min_periods=1).mean()
    gap = pdf["close"] - mean
    return (gap > 1e-9).astype("int32") - (gap < -1e-9).astype("int32")


@query("u1_dataframe_rule", with_(f"{MA}, {replay_sql()}, {trades_sql()}, {metrics_sql()}",
  f"SELECT symbol, n_trades, n_wins, {r('sharpe_ratio', None, 6)}, {r('win_rate', None, 6)} FROM met"))
def u1(spark, sf):
    out = backtest_rule(with_rule(bars(spark, sf), above_average, rows=10))
    return rounded(out.select("symbol", "n_trades", "n_wins", "sharpe_ratio", "win_rate"), 6)


@query("u2_pandas_rule", with_(MA, "SELECT symbol, bar_idx, CASE WHEN close - m > 1e-9 THEN 1 WHEN close - m < -1e-9 THEN -1 ELSE 0 END AS signal FROM ma"))
def u2(spark, sf):
    return with_pandas_rule(bars(spark, sf), above_average_pandas, rows=10).select("symbol", "bar_idx", "signal")
