"""The trend-following strategy end to end: bars -> smooth line -> stops -> signals -> account."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import columns as fx
from tidemark.operators import backtest as bt, metrics as mt
from tidemark.operators.series import chunk_window, drop_halo, ewm_mean, lay_out, trailing, with_ordinal
from tidemark.operators.smooth import smooth
from tidemark.plans.staging import stage
from tidemark.schema import SERIES


@dataclass(frozen=True)
class Trend:
    min_trend_bars: int = 24
    cutoff_scale: float = 1.0
    stop: str = "residual"  # "atr", "residual" or "quantile"
    atr_period: int = 14
    window: int = 20
    quantile: float = 0.95
    k_stop: float = 2.0
    k_profit: float = 3.0
    slope_threshold: float = 0.0
    slope_lookback: int = 1
    min_volatility: float = 0.0

    @property
    def look_back(self) -> int:
        return max(self.window - 1 if self.stop != "atr" else 1, self.slope_lookback, 1)


def indexed(bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return bars if "bar_idx" in bars.columns else with_ordinal(bars, keys)


def add_true_range(bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    laid = lay_out(indexed(bars, keys), back=1)
    return drop_halo(laid.withColumn("tr", fx.true_range(chunk_window(keys)))).drop("chunk")


def add_atr(bars: DataFrame, period: int, keys: list[str] = SERIES, name: str = "atr") -> DataFrame:
    return ewm_mean(add_true_range(bars, keys), "tr", period, name, keys).drop("tr")


def add_smoothed(bars: DataFrame, rule: Trend, keys: list[str] = SERIES) -> DataFrame:
    cutoff = fx.cutoff_fraction(rule.min_trend_bars, F.col("n_bars"), rule.cutoff_scale)
    return smooth(indexed(bars, keys), cutoff, keys=keys)


def band_width(rule: Trend, keys: list[str] = SERIES):
    frame = trailing(keys, rule.window)
    if rule.stop == "atr":
        return F.col("atr")
    if rule.stop == "residual":
        return fx.residual_sigma("close", "smoothed", frame)
    if rule.stop == "quantile":
        return fx.residual_quantile("close", "smoothed", frame, rule.quantile)
    raise ValueError(f"unknown stop type {rule.stop!r}")


def trend_signals(bars: DataFrame, rule: Trend = Trend(), keys: list[str] = SERIES) -> DataFrame:
    """Chunked bars with smoothed, stop bands, ``signal`` and ``sig1`` (ready for ``positions``)."""
    d = add_smoothed(bars, rule, keys)
    if rule.stop == "atr":
        d = add_atr(d, rule.atr_period, keys)
    d = lay_out(d, back=rule.look_back + 1)
    w = chunk_window(keys)
    centre = "close" if rule.stop == "atr" else "smoothed"
    d = d.withColumn("width", band_width(rule, keys))
    d = d.withColumns(fx.stop_bands(centre, "width", rule.k_stop, rule.k_profit))
    rise = fx.slope("smoothed", rule.slope_lookback, w)
    entry = fx.trend_entry("close", "smoothed", w, rise, rule.slope_threshold, rule.min_volatility, "width")
    leave = fx.any_of(fx.crosses_below("close", "smoothed", w), F.col("close") < F.col("long_stop"))
    d = d.withColumn("signal", fx.signal_code(entry, leave))
    return drop_halo(d.withColumn("sig1", F.lag("signal").over(w)))


def run_trend(
    bars: DataFrame, rule: Trend = Trend(), account: bt.Account = bt.Account(), keys: list[str] = SERIES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(account per bar, trade log, metrics per series); bars are read twice, the account once."""
    pos = stage(bt.positions(stage(trend_signals(bars, rule, keys)), keys, account))
    trades = bt.closed_trades(pos, keys, account)
    return pos, trades, mt.summarise(pos, trades, account.capital, keys)
