"""Portfolio weights, rebalancing, simulation and risk on long return frames.

Return frames hold ``portfolio, symbol, t, ret`` (``t`` = 0-based aligned bar); weights hold
``portfolio, symbol, weight``; covariances ``portfolio, sym_i, sym_j, value`` for both orders.
Matrices are never built on the driver; only a portfolio's own n x n block ever sits in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators import metrics as mt
from tidemark.operators.align import in_windows
from tidemark.operators.moments import correlation_of, pair_moments, pearson, sample_covariance
from tidemark.operators.series import running
from tidemark.plans.staging import stage

PK = ["portfolio"]
YEAR = 252 * 24


# --- weights ------------------------------------------------------------------------------------

def equal_weights(members: DataFrame, keys: list[str] = PK) -> DataFrame:
    """1/n for every symbol of each portfolio."""
    each = members.select(*keys, "symbol").distinct()
    return each.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _share(df: DataFrame, value: Column, keys: list[str], name: str = "weight") -> DataFrame:
    """Replace by the share of the group total; a non-positive total leaves values alone.

    Weight frames hold one row per member, so a window over a portfolio (at one check) is small.
    """
    d = df.withColumn("_v", value).withColumn("_sum", F.sum("_v").over(Window.partitionBy(*keys)))
    share = F.when(F.col("_sum") > 0, F.try_divide(F.col("_v"), F.col("_sum"))).otherwise(F.col("_v"))
    return d.withColumn(name, share).drop("_v", "_sum")


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def cap_weights(weights: DataFrame, low: float = 0.0, high: float = 1.0, keys: list[str] = PK) -> DataFrame:
    return _share(weights, _clip(F.col("weight"), low, high), keys)


def last_rows(returns: DataFrame, lookback: int, keys: list[str] = PK) -> DataFrame:
    ends = returns.groupBy(*keys).agg(F.max("t").alias("_end"))
    return returns.join(ends, keys).where(F.col("t") > F.col("_end") - lookback).drop("_end")


def _inverse_volatility(recent: DataFrame, low: float, high: float, keys: list[str]) -> DataFrame:
    vol = recent.groupBy(*keys, "symbol").agg(F.stddev_samp("ret").alias("_sd"))
    vol = vol.withColumn("_sd", F.when(F.col("_sd") != 0, F.col("_sd")))
    middle = F.median("_sd").over(Window.partitionBy(*keys))
    vol = vol.withColumn("_mid", middle).withColumn("_sd", F.greatest(F.coalesce("_sd", "_mid"), F.lit(1e-8)))
    raw = _share(vol, 1.0 / F.col("_sd"), keys)
    return cap_weights(raw, low, high, keys).select(*keys, "symbol", "weight")


def inverse_volatility_weights(
    returns: DataFrame, lookback: int = 60, low: float = 0.0, high: float = 1.0, keys: list[str] = PK
) -> DataFrame:
    return _inverse_volatility(last_rows(returns, lookback, keys), low, high, keys)


def market_cap_weights(
    members: DataFrame, caps: DataFrame, low: float = 0.0, high: float = 1.0, keys: list[str] = PK
) -> DataFrame:
    """Shares of market capitalisation (``symbol, cap``); an unknown cap counts as 1."""
    known = members.select(*keys, "symbol").join(caps.select("symbol", "cap"), "symbol", "left")
    raw = _share(known, F.coalesce(F.col("cap").cast("double"), F.lit(1.0)), keys)
    return cap_weights(raw, low, high, keys).select(*keys, "symbol", "weight")


def return_pairs(returns: DataFrame, keys: list[str] = PK, at: str = "t") -> DataFrame:
    """Both returns of every unordered pair of members (including a member with itself) per bar."""
    a = returns.select(*keys, at, F.col("symbol").alias("sym_i"), F.col("ret").alias("x"))
    b = returns.select(*keys, at, F.col("symbol").alias("sym_j"), F.col("ret").alias("y"))
    return a.join(b, [*keys, at]).where(F.col("sym_i") <= F.col("sym_j"))


def _both_orders(half: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    flipped = half.where(F.col("sym_i") < F.col("sym_j")).select(
        *keys, F.col("sym_j").alias("sym_i"), F.col("sym_i").alias("sym_j"), value
    )
    return half.select(*keys, "sym_i", "sym_j", value).unionByName(flipped)


def covariance(returns: DataFrame, keys: list[str] = PK) -> DataFrame:
    """Sample covariance of every pair of members over the bars both have, in both orders."""
    return covariance_of(pair_moments(returns, keys), keys)


def covariance_of(moments: DataFrame, keys: list[str] = PK) -> DataFrame:
    return _both_orders(moments.withColumn("value", sample_covariance()), keys)


def solve_risk_parity(
    cov: np.ndarray, low: float, high: float, rounds: int = 100, tol: float = 1e-6, damped: bool = True
) -> np.ndarray:
    """Multiplicative updates towards equal risk contributions.

    Undamped steps scale a weight by target/actual and may oscillate; the damped ones take the
    square root of that factor.
    """
    n = len(cov)
    w = np.full(n, 1.0 / n)
    for _ in range(rounds):
        pull = cov @ w
        variance = w @ pull
        if variance < 1e-10:
            return w
        factor = variance / n / np.maximum(w * pull, 1e-10)
        moved = np.clip(w * (np.sqrt(factor) if damped else factor), low, high)
        moved = moved / moved.sum()
        done = np.abs(moved - w).max() < tol
        w = moved
        if done:
            break
    return w


def _risk_parity(cov: DataFrame, low: float, high: float, damped: bool, keys: list[str]) -> DataFrame:
    fields = [f for f in cov.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("symbol", T.StringType()), T.StructField("weight", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        square = pdf.pivot(index="sym_i", columns="sym_j", values="value")
        # members without two bars in common with others cannot be weighed: the one that lacks most goes first
        while square.isna().to_numpy().any():
            worst = square.isna().sum().idxmax()
            square = square.drop(index=worst, columns=worst)
        out = pd.DataFrame({"symbol": square.index, "weight": solve_risk_parity(square.to_numpy(float), low, high, damped=damped)})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return cov.groupBy(*keys).applyInPandas(solve, schema)


def risk_parity_weights(
    returns: DataFrame, lookback: int = 60, low: float = 0.0, high: float = 1.0, method: str = "damped",
    keys: list[str] = PK,
) -> DataFrame:
    """Approximately equal risk contributions; ``method="reference"`` takes undamped steps.

    A member that has no two bars in common with the others gets no weight row.
    """
    cov = covariance(last_rows(returns, lookback, keys), keys)
    return _risk_parity(cov, low, high, method == "damped", keys)


# --- rebalancing and simulation -----------------------------------------------------------------

def check_windows(returns: DataFrame, frequency: int, lookback: int, keys: list[str] = PK) -> DataFrame:
    """Every return once per rebalance check that looks at it: check i sees [i - lookback, i).

    Check 0 (the initial weights) sees the last ``lookback`` bars of the whole sample.
    """
    ends = returns.groupBy(*keys).agg(F.max("t").alias("_end"))
    d = returns.join(ends, keys)
    first = (F.floor(F.col("t") / frequency) + 1) * frequency
    last = F.least(F.floor((F.col("t") + lookback) / frequency) * frequency, F.floor(F.col("_end") / frequency) * frequency)
    nothing = F.array().cast("array<bigint>")
    later = F.when(first <= last, F.sequence(first, last, F.lit(frequency).cast("long"))).otherwise(nothing)
    initial = F.when(F.col("t") > F.col("_end") - lookback, F.array(F.lit(0).cast("long"))).otherwise(nothing)
    return d.withColumn("check", F.explode(F.concat(later, initial))).drop("_end")


def target_weights(
    returns: DataFrame, method: str, frequency: int, lookback: int, low: float = 0.0, high: float = 1.0,
    keys: list[str] = PK,
) -> DataFrame:
    """Target weights at every check, all checks in one job: (keys, check, symbol, weight)."""
    at = [*keys, "check"]
    seen = check_windows(returns, frequency, lookback, keys)
    if method == "volatility":
        return _inverse_volatility(seen, low, high, at)
    if method.startswith("risk_parity"):
        return _risk_parity(covariance(seen, at), low, high, method != "risk_parity_reference", at)
    return equal_weights(seen, at)


def rebalance(current: DataFrame, target: DataFrame, threshold: float = 0.05, keys: list[str] = PK) -> DataFrame:
    """One decision per portfolio: target weights if any deviates by more than the threshold (or the
    members differ), else the current ones."""
    both = current.withColumnRenamed("weight", "_now").join(
        target.withColumnRenamed("weight", "_goal"), [*keys, "symbol"], "full"
    )
    missing = F.col("_now").isNull() | F.col("_goal").isNull()
    off = missing | F.coalesce(F.abs(F.col("_now") - F.col("_goal")) > threshold, F.lit(True))
    out = both.withColumn("rebalanced", F.bool_or(off).over(Window.partitionBy(*keys)))
    weight = F.when(F.col("rebalanced"), F.col("_goal")).otherwise(F.col("_now"))
    return out.withColumn("weight", weight).where(F.col("weight").isNotNull()).select(*keys, "symbol", "weight", "rebalanced")


def simulate(
    returns: DataFrame, accepted: DataFrame, capital: float = 10000.0, keys: list[str] = PK
) -> DataFrame:
    """Equity per bar from the accepted weights: (keys, bar_idx, ret, equity)."""
    ends = returns.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("check")
    spans = accepted.select(*keys, "check").distinct().withColumn("_next", F.lead("check").over(w)).join(ends, keys)
    spans = spans.select(*keys, "check", F.coalesce("_next", "_n").alias("until"))
    held = accepted.join(spans, [*keys, "check"]).withColumnRenamed("check", "since")
    rows = in_windows(returns.withColumnRenamed("t", "bar_idx"), held, "since", "until", [*keys, "symbol"])
    moved = rows.groupBy(*keys, "bar_idx").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    moved = moved.withColumn("ret", F.when(F.col("bar_idx") == 0, 0.0).otherwise(F.col("ret")))
    grown = running(moved, {"_g": ("product", 1 + F.col("ret"))}, keys)
    return grown.select(*keys, "bar_idx", "ret", (capital * F.col("_g")).alias("equity"))


# --- analytics ----------------------------------------------------------------------------------

def correlation(
    returns: DataFrame, method: str = "pearson", min_periods: int = 30, keys: list[str] = PK, moments: DataFrame | None = None
) -> DataFrame:
    """Correlation of every unordered pair (and of each member with itself) over the bars both have.

    ``moments`` are those of ``returns``, where they are known already. Ranks of a member serve all its pairs with
    members that have the same bars; other pairs are ranked over their own bars.
    """
    pair = [*keys, "sym_i", "sym_j"]
    if method == "kendall":
        return _kendall(return_pairs(returns, keys).where(F.col("x").isNotNull() & F.col("y").isNotNull()), pair, min_periods)
    if method == "spearman":
        return _spearman(returns, keys, min_periods)
    if method != "pearson":
        raise ValueError(f"unknown correlation {method!r}")
    known = pair_moments(returns, keys) if moments is None else moments
    return known.select(*pair, pearson(min_periods).alias("corr"))


def _spearman(returns: DataFrame, keys: list[str], min_periods: int) -> DataFrame:
    pair = [*keys, "sym_i", "sym_j"]
    known = returns.where(F.col("ret").isNotNull())
    member = [*keys, "symbol"]
    ranks = _average_ranks(known, "ret", member)
    ranked = known.join(ranks, [*member, "ret"]).select(*member, "t", F.col("_rank_ret").alias("ret"))
    moments = stage(pair_moments(ranked, keys))
    own = moments.where("sym_i = sym_j")
    n_of = lambda sym: own.select(*keys, F.col("sym_i").alias(sym), F.col("n").alias(f"_n_{sym}"))
    whole = moments.join(n_of("sym_i"), [*keys, "sym_i"]).join(n_of("sym_j"), [*keys, "sym_j"])
    alike = whole.where("n = _n_sym_i and n = _n_sym_j").select(*pair, pearson(min_periods).alias("corr"))
    ragged = whole.where("n < _n_sym_i or n < _n_sym_j").select(*pair)
    # only bars of members in such pairs are paired up
    some = ragged.select(*keys, F.col("sym_i").alias("symbol")).union(ragged.select(*keys, F.col("sym_j").alias("symbol"))).distinct()
    both = return_pairs(known.join(some, member, "left_semi"), keys).join(ragged, pair, "left_semi")
    for x in ("x", "y"):
        both = both.join(_average_ranks(both, x, pair), [*pair, x])
    own_ranks = both.groupBy(*pair).agg(F.when(F.count(F.lit(1)) >= min_periods, correlation_of("_rank_x", "_rank_y")).alias("corr"))
    return alike.unionByName(own_ranks)


def _average_ranks(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Average-tie rank of every distinct value, and how often it stands: (keys, x, _rank_x, _n_x).

    Ties are counted before the shuffle, so a value holding most rows is one row here. The values are dealt in ranges
    of about equal size, however they are spread, and the written ranges are numbered with offsets.
    """
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    ranges = stage(counts.repartitionByRange(*keys, x).withColumn("chunk", F.spark_partition_id()))
    ranked = running(ranges, {"_upto": ("sum", F.col("_n").cast("double"))}, keys, order=x)
    return ranked.select(*keys, x, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"_rank_{x}"), F.col("_n").alias(f"_n_{x}"))


def inversions(values: np.ndarray, base: int = 64) -> int:
    """Pairs out of order: all pairs within runs of ``base``, then bottom-up merging (n log n)."""
    n = len(values)
    runs = np.full(-(-n // base) * base, np.inf)
    runs[:n] = values
    runs = runs.reshape(-1, base)
    total = 0
    for at in range(0, len(runs), 1024):
        some = runs[at : at + 1024]
        total += int(np.triu(some[:, :, None] > some[:, None, :]).sum())
    v, width = np.sort(runs, axis=1).ravel(), base
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = v[at : at + width], v[at + width : at + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            v[at : at + 2 * width] = np.sort(np.concatenate([left, right]), kind="stable")
        width *= 2
    return total


#: Blocks of ranks of a pair, and ranks of a block at least.
RANK_BLOCKS, RANK_BLOCK = 1024, 4096


def _kendall(both: DataFrame, pair: list[str], min_periods: int) -> DataFrame:
    """Tau-b per pair.

    Both sides are cut into blocks of ranks, ties never split and a value that fills a block alone in one of its own.
    Bars out of order are counted inside blocks of x, inside blocks of y between blocks of x, and between blocks of both
    from their counts: no task sees more of a pair than a block or the counts.
    """
    both = stage(both.select(*pair, "x", "y"))
    totals = both.groupBy(*pair).agg(F.count(F.lit(1)).alias("_total"))
    size = F.greatest(F.lit(RANK_BLOCK), F.ceil(F.col("_total") / RANK_BLOCKS))
    d, ties = both.join(totals, pair), {}
    for x in ("x", "y"):
        ranks = stage(_average_ranks(both, x, pair))
        count = F.col(f"_n_{x}")
        ties[x] = ranks.groupBy(*pair).agg(F.sum(count * (count - 1) / 2).alias(f"_t{x}"))
        d = d.join(ranks, [*pair, x])
        first = F.col(f"_rank_{x}") - (count - 1) / 2 - 1
        d = d.withColumn(f"_b{x}", (2 * F.floor(first / size) + (count >= size).cast("int")).cast("long"))
    d = stage(d.select(*pair, "x", "y", "_bx", "_by"))
    same = both.groupBy(*pair, "x", "y").agg(F.count(F.lit(1)).alias("_c"))
    ties["xy"] = same.groupBy(*pair).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias("_txy"))

    schema = T.StructType([*[f for f in both.schema.fields if f.name in pair], T.StructField("_swaps", T.DoubleType())])

    def counted(key: tuple, swaps: float) -> pd.DataFrame:
        return pd.DataFrame([[*key[: len(pair)], float(swaps)]], columns=schema.names)

    def in_x(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        return counted(key, inversions(y[np.lexsort((y, pdf["x"].to_numpy(float)))]))

    def in_y(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)
        return counted(key, inversions(y[np.lexsort((y, pdf["_bx"].to_numpy()))]))

    def between(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (_, row), (_, column) = (np.unique(pdf[c].to_numpy(), return_inverse=True) for c in ("_bx", "_by"))
        cells = np.zeros((row.max() + 1, column.max() + 1))
        cells[row, column] = pdf["_c"].to_numpy()
        # what stands in later blocks of x and earlier ones of y
        later = np.cumsum(cells[::-1], axis=0)[::-1] - cells
        return counted(key, (cells * (np.cumsum(later, axis=1) - later)).sum())

    # a block of odd number holds one value: nothing in it is out of order
    parts = d.where("_bx % 2 = 0").groupBy(*pair, "_bx").applyInPandas(in_x, schema)
    parts = parts.unionByName(d.where("_by % 2 = 0").groupBy(*pair, "_by").applyInPandas(in_y, schema))
    cells = d.groupBy(*pair, "_bx", "_by").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.unionByName(cells.groupBy(*pair).applyInPandas(between, schema))
    out = totals.join(parts.groupBy(*pair).agg(F.sum("_swaps").alias("_swaps")), pair)
    for table in ties.values():
        out = out.join(table, pair)
    every = F.col("_total") * (F.col("_total") - 1) / 2
    spread = F.sqrt(every - F.col("_tx")) * F.sqrt(every - F.col("_ty"))
    tau = (every - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.col("_swaps")) / F.nullif(spread, F.lit(0.0))
    return out.select(*pair, F.when(F.col("_total") >= min_periods, tau).alias("corr"))


def risk_contributions(weights: DataFrame, cov: DataFrame, keys: list[str] = PK) -> DataFrame:
    """w_i (Cov w)_i; the contributions of a portfolio add up to its variance."""
    wi = weights.select(*keys, F.col("symbol").alias("sym_i"), F.col("weight").alias("_wi"))
    wj = weights.select(*keys, F.col("symbol").alias("sym_j"), F.col("weight").alias("_wj"))
    terms = cov.join(wi, [*keys, "sym_i"]).join(wj, [*keys, "sym_j"])
    return terms.groupBy(*keys, F.col("sym_i").alias("symbol")).agg(
        F.sum(F.col("_wi") * F.col("_wj") * F.col("value")).alias("contribution")
    )


def portfolio_volatility(weights: DataFrame, cov: DataFrame, keys: list[str] = PK) -> DataFrame:
    total = risk_contributions(weights, cov, keys).groupBy(*keys).agg(F.sum("contribution").alias("_v"))
    return total.select(*keys, F.sqrt(F.greatest("_v", F.lit(0.0))).alias("volatility"))


def diversification_ratio(weights: DataFrame, cov: DataFrame, keys: list[str] = PK) -> DataFrame:
    own = cov.where(F.col("sym_i") == F.col("sym_j")).select(
        *keys, F.col("sym_i").alias("symbol"), F.sqrt("value").alias("_sd")
    )
    avg = weights.join(own, [*keys, "symbol"]).groupBy(*keys).agg(F.sum(F.col("weight") * F.col("_sd")).alias("_avg"))
    d = avg.join(portfolio_volatility(weights, cov, keys), keys)
    ratio = F.when(F.col("volatility") < 1e-10, 1.0).otherwise(F.try_divide(F.col("_avg"), F.col("volatility")))
    return d.select(*keys, ratio.alias("diversification_ratio"))


def concentration(weights: DataFrame, keys: list[str] = PK) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("weight"), "symbol")
    hhi = F.sum(F.col("weight") * F.col("weight"))
    return weights.withColumn("_r", F.row_number().over(best)).groupBy(*keys).agg(
        hhi.alias("herfindahl_index"), F.coalesce(F.try_divide(F.lit(1.0), hhi), F.lit(0.0)).alias("effective_n"),
        F.max("weight").alias("max_weight"),
        F.sum(F.when(F.col("_r") <= 3, F.col("weight"))).alias("top3_concentration"),
    )


def tracking_error(ours: DataFrame, benchmark: DataFrame, time: str = "t", keys: list[str] = PK) -> DataFrame:
    """Annualised deviation of the return difference over common times."""
    both = ours.select(*keys, time, F.col("ret").alias("_a")).join(benchmark.select(time, F.col("ret").alias("_b")), time)
    gap = F.stddev_samp(F.col("_a") - F.col("_b"))
    return both.groupBy(*keys).agg((gap * F.sqrt(F.lit(252.0))).alias("tracking_error"))


def beta(assets: DataFrame, market: DataFrame, time: str = "t", keys: list[str] | None = None) -> DataFrame:
    """Covariance over market variance; 1 with fewer than two rows or a flat market."""
    keys = keys or [*PK, "symbol"]
    both = assets.select(*keys, time, F.col("ret").alias("_a")).join(market.select(time, F.col("ret").alias("_m")), time)
    var = F.var_samp("_m")
    value = F.when((F.count(F.lit(1)) < 2) | (var < 1e-10), 1.0).otherwise(F.covar_samp("_a", "_m") / F.nullif(var, F.lit(0.0)))
    return both.groupBy(*keys).agg(value.alias("beta"))


def sector_exposure(weights: DataFrame, sectors: DataFrame, keys: list[str] = PK) -> DataFrame:
    d = weights.join(sectors.select("symbol", "sector"), "symbol", "left")
    return d.groupBy(*keys, F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum("weight").alias("exposure"))


def rebased(curves: DataFrame, keys: list[str], x: str = "equity") -> DataFrame:
    """Percent change against the first bar of each curve."""
    first = curves.groupBy(*keys).agg(F.min_by(x, "bar_idx").alias("_first"))
    return curves.join(first, keys).withColumn("percent", (F.col(x) / F.col("_first") - 1) * 100).drop("_first")


def portfolio_metrics(
    equity: DataFrame, weights: DataFrame, returns: DataFrame, capital: float = 10000.0, keys: list[str] = PK,
    cov: DataFrame | None = None,
) -> DataFrame:
    """Nine portfolio metrics, annualised with 252 * 24 periods; ``cov`` is the covariance of ``returns``, if known already."""
    cov = covariance(returns, keys) if cov is None else cov
    curve = mt.with_drawdown(equity.select(*keys, "bar_idx", "ret", "equity"), keys=keys)
    year = F.sqrt(F.lit(float(YEAR)))
    ret = F.when(F.col("bar_idx") > 0, F.col("ret"))
    sd, last = F.stddev_samp(ret), F.max_by("equity", "bar_idx")
    own = curve.groupBy(*keys).agg(
        ((last - capital) / capital).alias("total_return"),
        (sd * year).alias("annualized_vol"),
        F.when(sd * year > 1e-10, F.avg(ret) / F.nullif(sd, F.lit(0.0)) * year).otherwise(0.0).alias("sharpe_ratio"),
        *[c.alias(n) for n, c in mt.max_drawdown_columns().items()],
    )
    shape = concentration(weights, keys).withColumnRenamed("effective_n", "effective_n_assets").drop("top3_concentration")
    return own.join(shape, keys).join(diversification_ratio(weights, cov, keys), keys)
