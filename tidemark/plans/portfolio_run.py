"""Portfolio back-test: targets at every check, accepted rebalances, equity, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import portfolio as pf
from tidemark.operators.moments import pair_moments
from tidemark.operators.rebalance import accept_targets
from tidemark.plans.staging import stage


@dataclass(frozen=True)
class Policy:
    weighting: str = "equal"  # "equal", "volatility", "risk_parity", "risk_parity_reference"
    frequency: int = 24
    threshold: float = 0.05
    low: float = 0.0
    high: float = 1.0
    lookback: int = 60


@dataclass
class PortfolioRun:
    accepted: DataFrame
    equity: DataFrame
    weights: DataFrame
    correlation: DataFrame
    metrics: DataFrame


def run_portfolio(
    returns: DataFrame, policy: Policy = Policy(), capital: float = 10000.0, keys: list[str] = pf.PK
) -> PortfolioRun:
    """Simulate every portfolio in ``returns`` (portfolio, symbol, t, ret) under one policy."""
    targets = pf.target_weights(returns, policy.weighting, policy.frequency, policy.lookback, policy.low, policy.high, keys)
    accepted = stage(accept_targets(targets, policy.threshold, keys))
    equity = stage(pf.simulate(returns, accepted, capital, keys))
    newest = accepted.groupBy(*keys, "symbol").agg(F.max_by("weight", "check").alias("weight"))
    moments = stage(pair_moments(returns, keys))
    cov = pf.covariance_of(moments, keys)
    checks = accepted.groupBy(*keys).agg(F.count_distinct("check").alias("n_rebalances"))
    vol = pf.portfolio_volatility(newest, cov, keys).withColumnRenamed("volatility", "portfolio_volatility")
    metrics = pf.portfolio_metrics(equity, newest, returns, capital, keys, cov).join(vol, keys).join(checks, keys)
    return PortfolioRun(accepted, equity, newest, pf.correlation(returns, keys=keys, moments=moments), metrics)
