"""Performance metrics of equity curves and trade logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.series import chunk_window, drop_halo, lay_out, running
from tidemark.schema import HOURS_PER_YEAR, SERIES

INF = "double('inf')"


def with_returns(df: DataFrame, x: str = "equity", name: str = "ret", keys: list[str] = SERIES) -> DataFrame:
    """Simple return against the bar before; NULL on the first bar and after a zero."""
    laid = lay_out(df, back=1)
    before = F.lag(x).over(chunk_window(keys))
    return drop_halo(laid.withColumn(name, F.try_divide(F.col(x) - before, before))).drop("chunk")


def with_drawdown(df: DataFrame, x: str = "equity", keys: list[str] = SERIES) -> DataFrame:
    d = running(df, {"peak": ("max", F.col(x))}, keys)
    d = d.withColumn("drawdown", F.col(x) - F.col("peak"))
    return d.withColumn("drawdown_pct", F.try_divide(F.col("drawdown"), F.col("peak"))).drop("chunk")


def max_drawdown_columns(order: str = "bar_idx") -> dict[str, Column]:
    """Deepest absolute drawdown, and its share of the peak at the first such bar."""
    worst = F.min(F.struct("drawdown", F.col(order), "peak"))
    return {
        "max_drawdown": worst["drawdown"],
        "max_drawdown_pct": F.when(worst["peak"] > 0, worst["drawdown"] / worst["peak"]).otherwise(0.0),
    }


def sharpe(ret: str | Column, periods: float) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(r)
    return F.when(F.count(r) == 0, 0.0).when(sd < 1e-10, 0.0).otherwise(F.avg(r) / sd * F.sqrt(F.lit(float(periods))))


def sortino(ret: str | Column, periods: float, target: float = 0.0) -> Column:
    """Infinite without downside returns or spread; NULL when there is exactly one."""
    r = F.col(ret) if isinstance(ret, str) else ret
    down = F.when(r < target, r)
    sd = F.when(F.min(down) == F.max(down), F.when(F.count(down) > 1, 0.0)).otherwise(F.stddev_samp(down))
    return (
        F.when(F.count(r) == 0, 0.0)
        .when((F.count(down) == 0) | (sd == 0), F.expr(INF))
        .otherwise((F.avg(r) - target) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(periods))))
    )


def annualised(growth: Column, n_bars: Column, periods: float = HOURS_PER_YEAR) -> Column:
    return F.pow(growth, periods / n_bars) - 1


def equity_metrics(
    df: DataFrame, capital: float, keys: list[str] = SERIES, periods: float = HOURS_PER_YEAR
) -> DataFrame:
    """Curve metrics; needs equity, ret, peak, drawdown, bar_idx. A column ``initial_capital`` stands for ``capital``."""
    capital = F.first("initial_capital") if "initial_capital" in df.columns else F.lit(float(capital))
    final = F.max_by("equity", "bar_idx")
    return df.groupBy(*keys).agg(
        ((final - capital) / capital).alias("total_return"),
        (final / capital - 1).alias("cumulative_return"),
        annualised(final / capital, F.count(F.lit(1)), periods).alias("annualized_return"),
        *[c.alias(n) for n, c in max_drawdown_columns().items()],
        sharpe("ret", periods).alias("sharpe_ratio"),
        sortino("ret", periods).alias("sortino_ratio"),
    )


TRADE_METRICS = [
    "n_trades", "n_wins", "n_losses", "win_rate", "profit_factor", "avg_win", "avg_loss",
    "avg_bars_held", "avg_mae", "avg_mfe", "avg_mae_pct", "avg_mfe_pct",
]


def trade_metrics(trades: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    pnl = F.col("pnl")
    t = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(pnl > 0).alias("n_wins"),
        F.count_if(pnl <= 0).alias("n_losses"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("_won"),
        F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0))).alias("_lost"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("bars_held", "mae", "mfe", "mae_pct", "mfe_pct")],
    )
    return (
        t.withColumn("win_rate", F.col("n_wins") / F.col("n_trades"))
        .withColumn("profit_factor", F.when(F.col("_lost") > 0, F.col("_won") / F.nullif("_lost", F.lit(0.0))).otherwise(F.expr(INF)))
        .withColumn("avg_win", F.coalesce(F.try_divide(F.col("_won"), F.col("n_wins")), F.lit(0.0)))
        .withColumn("avg_loss", F.coalesce(F.try_divide(F.col("_lost"), F.col("n_losses")), F.lit(0.0)))
        .select(*keys, *TRADE_METRICS)
    )


def summarise(equity: DataFrame, trades: DataFrame, capital: float, keys: list[str] = SERIES) -> DataFrame:
    """All nineteen metrics per key; a key without trades gets zeros."""
    both = equity_metrics(equity, capital, keys).join(trade_metrics(trades, keys), keys, "left")
    return both.fillna(0, subset=TRADE_METRICS)


def exit_reasons(trades: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("n"))
