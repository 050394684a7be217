"""User strategy rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.backtest import Account, closed_trades, positions, with_previous_signal
from tidemark.operators.metrics import summarise
from tidemark.plans.staging import stage
from tidemark.plans.strategy import indexed
from tidemark.schema import SERIES


def with_rule(bars: DataFrame, rule: Callable[..., DataFrame], **params) -> DataFrame:
    """A rule written on DataFrames: it adds an integer ``signal`` in {-2, -1, 0, 1, 2}."""
    out = indexed(bars).transform(rule, **params)
    if "signal" not in out.columns:
        raise ValueError("a strategy rule must add a 'signal' column")
    return out


def with_pandas_rule(bars: DataFrame, rule: Callable[..., object], keys: list[str] = SERIES, **params) -> DataFrame:
    """A rule written on pandas: one call per series with its bars in time order."""
    d = indexed(bars, keys)
    schema = T.StructType([*d.schema.fields, T.StructField("signal", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        return pdf.assign(signal=rule(pdf, **params))

    return d.groupBy(*keys).applyInPandas(run, schema)


def backtest_rule(signals: DataFrame, account: Account = Account(), keys: list[str] = SERIES) -> DataFrame:
    """Metrics per series of any frame carrying ``signal``."""
    pos = stage(positions(stage(with_previous_signal(signals, keys)), keys, account))
    return summarise(pos, closed_trades(pos, keys, account), account.capital, keys).withColumn("capital", F.lit(account.capital))
