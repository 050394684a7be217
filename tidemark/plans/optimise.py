"""Parameter search over many series at once: series x candidates (x windows) in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import columns as fx
from tidemark.operators import align, backtest as bt, metrics as mt, search as so
from tidemark.operators.series import chunk_window, drop_halo, ewm_mean, lay_out
from tidemark.operators.smooth import smooth, smooth_for_candidates
from tidemark.plans.staging import stage
from tidemark.plans.strategy import add_true_range
from tidemark.schema import HOURS_PER_YEAR, SERIES

#: Shorter series are not scored.
MIN_BARS = 100
#: Metric and parameter names with their defaults.
METRICS = [
    "total_return", "cumulative_return", "annualized_return", "max_drawdown", "max_drawdown_pct",
    "sharpe_ratio", "sortino_ratio", *mt.TRADE_METRICS,
]
COUNTS = {"n_trades", "n_wins", "n_losses"}
DEFAULTS = {
    "min_trend_period_hours": 48.0, "cutoff_scale": 1.0, "atr_period": 14, "k_stop": 2.0, "k_profit": 3.0,
    "slope_threshold": 0.0, "slope_lookback": 1,
}


def prepare(bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """The columns an evaluation needs, with true range computed once per series."""
    kept = [*keys, "bar_idx", "n_bars", "open_time", "open", "high", "low", "close", "tr"]
    return add_true_range(bars, keys).select(*kept)


def account_frame(
    d: DataFrame, keys: list[str], hours_per_bar: float, lookbacks: list[int], account: bt.Account = bt.Account(),
    max_atr: int | None = None,
) -> DataFrame:
    """Smooth, ATR-stop, signal and replay every (series, candidate) of ``d``."""
    for name, value in DEFAULTS.items():
        if name not in d.columns:
            d = d.withColumn(name, F.lit(value))
    if "smoothed" not in d.columns:
        period = (F.col("min_trend_period_hours") / hours_per_bar).cast("int")
        safe = F.when(period > 0, period)
        cutoff = F.coalesce(fx.cutoff_fraction(safe, F.col("n_bars"), F.col("cutoff_scale")), F.lit(1.0))
        d = smooth(d.withColumn("_period", period), cutoff, keys=keys).drop("_period")
        d = ewm_mean(d, "tr", F.col("atr_period"), "atr", keys, max_atr)
    d = lay_out(d, back=max(lookbacks) + 1)
    w = chunk_window(keys)
    rise = fx.slope_by("smoothed", F.col("slope_lookback"), lookbacks, w)
    entry = fx.crosses_above("close", "smoothed", w) & fx.holds(rise > F.col("slope_threshold"))
    stop = F.col("close") < F.col("close") - F.col("k_stop") * F.col("atr")
    leave = fx.any_of(fx.crosses_below("close", "smoothed", w), stop)
    d = d.withColumn("signal", fx.signal_code(entry, leave))
    d = drop_halo(d.withColumn("sig1", F.lag("signal").over(w)))
    kept = [*keys, "chunk", "bar_idx", "n_bars", "open_time", "open", "high", "low", "close", "sig1"]
    kept += [c for c in bt.MONEY if c in d.columns]
    return stage(bt.positions(stage(d.select(*kept)), keys, account))


def evaluate(
    d: DataFrame, keys: list[str], hours_per_bar: float = 1.0, lookbacks: list[int] | None = None,
    account: bt.Account = bt.Account(), max_atr: int | None = None, worst: float = float("-inf"),
) -> DataFrame:
    """Nineteen metrics per key; series of fewer than MIN_BARS bars, or with prices that cannot be traded at,
    score ``worst`` and the others go on."""
    enough = d.where(F.col("n_bars") >= MIN_BARS)
    pos = account_frame(enough, keys, hours_per_bar, lookbacks or list(range(1, 6)), account, max_atr)
    scored = mt.summarise(pos, bt.closed_trades(pos, keys, account), account.capital, keys)
    # an account without a value at some bar (a price of zero or none) has no score
    broken = pos.where(F.col("equity").isNull()).select(*keys, F.lit(True).alias("_broken")).distinct()
    scored = scored.join(broken, keys, "left").withColumns({
        m: F.when(F.col("_broken"), F.lit(worst)).otherwise(F.col(m)) for m in METRICS if m not in COUNTS
    }).drop("_broken")
    short = d.where((F.col("n_bars") < MIN_BARS) & (F.col("bar_idx") == 0)).select(
        *keys, F.lit(worst).alias("sharpe_ratio")
    )
    return scored.unionByName(short, allowMissingColumns=True)


@dataclass(frozen=True)
class Search:
    space: so.Space
    method: str = "random"  # "grid", "random" or "bayesian"
    points: int = 5
    n: int = 100
    n_initial: int = 10
    seed: int = 0
    metric: str = "sharpe_ratio"
    maximize: bool = True

    @property
    def worst(self) -> float:
        return float("-inf") if self.maximize else float("inf")

    @property
    def size(self) -> int:
        return so.grid_size(self.space, self.points) if self.method == "grid" else self.n

    def columns(self, param_id: Column) -> dict[str, Column]:
        if self.method == "grid":
            return so.grid_columns(self.space, self.points, param_id)
        return so.random_columns(self.space, param_id, self.seed)

    def __post_init__(self):
        known = {*DEFAULTS, *bt.MONEY}
        if unknown := sorted(set(self.space) - known):
            raise ValueError(f"no parameter is called {', '.join(unknown)}; known: {sorted(known)}")

    def whole(self, name: str) -> list[int]:
        """All values that a whole-number parameter can take."""
        axis = self.space.get(name)
        if axis is None:
            return [DEFAULTS[name]]
        if axis.kind == "float" or any(v != int(v) for v in axis.choices):
            raise ValueError(f"{name} takes whole numbers only")
        return sorted({int(v) for v in axis.choices}) if axis.kind == "choice" else list(range(int(axis.low), int(axis.high) + 1))

    @property
    def lookbacks(self) -> list[int]:
        return self.whole("slope_lookback")

    @property
    def max_atr(self) -> int:
        return max(self.whole("atr_period"))


def search(prepared: DataFrame, spec: Search, keys: list[str] = SERIES, hours_per_bar: float = 1.0) -> DataFrame:
    """Evaluate the candidates of ``spec`` on every series: params and metrics per (series, param_id)."""
    if spec.method == "bayesian":
        return _bayesian(prepared, spec, keys, hours_per_bar)
    d = _with_shared_lines(prepared, spec, keys, hours_per_bar)
    scores = evaluate(d, [*keys, "param_id"], hours_per_bar, spec.lookbacks, max_atr=spec.max_atr, worst=spec.worst)
    return scores.withColumns(spec.columns(F.col("param_id")))


def _with_shared_lines(prepared: DataFrame, spec: Search, keys: list[str], hours_per_bar: float) -> DataFrame:
    """Every bar once per candidate with ``smoothed`` and ``atr``.

    The line depends on period and scale only and the range on its span only, so a series is transformed
    once and candidates pick theirs. The settings of the search are listed on the driver, never data.
    """
    names = ("min_trend_period_hours", "cutoff_scale", "atr_period")
    columns = spec.columns(F.col("param_id"))
    ids = prepared.sparkSession.range(spec.size).select(F.col("id").alias("param_id"))
    told = ids.select("param_id", *[columns.get(n, F.lit(DEFAULTS[n])).alias(n) for n in names]).orderBy("param_id").collect()
    shape = [(int(r[1] / hours_per_bar), float(r[2])) for r in told]
    span = [int(r[3]) for r in told]
    shapes, spans = sorted(set(shape)), sorted(set(span))
    d = smooth_for_candidates(prepared, shapes, spans, keys)
    d = so.with_candidates(d, spec.size, columns)

    def pick(values: str, at: list[int]) -> Column:
        return F.element_at(values, F.element_at(F.lit(at), (F.col("param_id") + 1).cast("int")))

    return d.withColumns({
        "smoothed": pick("lines", [shapes.index(s) + 1 for s in shape]), "atr": pick("ranges", [spans.index(s) + 1 for s in span]),
    }).drop("lines", "ranges")


def _bayesian(prepared: DataFrame, spec: Search, keys: list[str], hours_per_bar: float) -> DataFrame:
    """Random start, then one batch of suggestions per series from the start's posterior."""
    first = Search(spec.space, "random", n=spec.n_initial, seed=spec.seed, metric=spec.metric)
    start = stage(search(prepared, first, keys, hours_per_bar))
    sign = 1.0 if spec.maximize else -1.0
    seen = start.withColumn("score", sign * F.col(spec.metric))
    later = stage(so.suggest(seen, spec.space, keys, spec.n, spec.seed))
    later = later.withColumn("param_id", F.col("slot") + spec.n_initial).drop("slot", "gain")
    ids = fx.each(spec.n_initial, spec.n_initial + spec.n - 1)
    d = prepared.withColumn("param_id", ids).join(later, [*keys, "param_id"])
    scores = evaluate(d, [*keys, "param_id"], hours_per_bar, spec.lookbacks, max_atr=spec.max_atr, worst=spec.worst)
    return start.unionByName(scores.join(later, [*keys, "param_id"]), allowMissingColumns=True)


# --- walk-forward -------------------------------------------------------------------------------

def walk_windows(
    lengths: DataFrame, train: int, test: int, step: int | None = None, anchored: bool = False
) -> DataFrame:
    """Index windows per series from its length ``n_bars``; the step defaults to the test size."""
    step = step or test
    last = F.col("n_bars") - train - test
    starts = F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("_at")
    others = [c for c in lengths.columns if c != "n_bars"]
    w = lengths.where(last >= 0).select(*others, starts)
    return w.select(
        *others,
        (F.col("_at") / step).cast("long").alias("window_id"),
        (F.lit(0) if anchored else F.col("_at")).cast("long").alias("train_start"),
        (F.col("_at") + train).alias("train_end"),
        (F.col("_at") + train).alias("test_start"),
        (F.col("_at") + train + test).alias("test_end"),
    )


def window_bars(prepared: DataFrame, windows: DataFrame, part: str, keys: list[str] = SERIES) -> DataFrame:
    """The train or test bars of every window as series of their own."""
    start, end = f"{part}_start", f"{part}_end"
    d = align.in_windows(prepared, windows.select(*keys, "window_id", start, end), start, end, keys)
    d = d.withColumn("bar_idx", F.col("bar_idx") - F.col(start)).withColumn("n_bars", F.col(end) - F.col(start))
    # the first bar of a window has no predecessor inside it
    first = F.col("bar_idx") == 0
    return d.withColumn("tr", F.when(first, F.col("high") - F.col("low")).otherwise(F.col("tr"))).drop(start, end)


@dataclass
class WalkForward:
    windows: DataFrame
    results: DataFrame
    best: DataFrame
    train: DataFrame
    test: DataFrame
    out_of_sample: DataFrame


def walk_forward(
    prepared: DataFrame, spec: Search, train: int, test: int, step: int | None = None, anchored: bool = False,
    keys: list[str] = SERIES, hours_per_bar: float = 1.0,
) -> WalkForward:
    """Pick the best candidate on each training window and score it on the following test window."""
    if spec.method == "grid":
        # n candidates are spread over the axes
        points = int(spec.n ** (1 / len(spec.space)))
        spec = Search(spec.space, "grid", points, spec.n, seed=spec.seed, metric=spec.metric, maximize=spec.maximize)
    elif spec.method == "bayesian":
        first = min(10, spec.n // 2)
        spec = Search(spec.space, "bayesian", n=spec.n - first, n_initial=first, seed=spec.seed, metric=spec.metric, maximize=spec.maximize)
    lengths = prepared.where(F.col("bar_idx") == 0).select(*keys, "n_bars")
    windows = walk_windows(lengths, train, test, step, anchored)
    wk = [*keys, "window_id"]
    results = stage(search(window_bars(prepared, windows, "train", keys), spec, wk, hours_per_bar))
    best = so.best_result(results, spec.metric, wk, spec.maximize)
    chosen = stage(best.select(*wk, "param_id", *spec.space))
    unseen = window_bars(prepared, windows, "test", keys).join(chosen.drop("param_id"), wk)
    scored = stage(evaluate(unseen, wk, hours_per_bar, spec.lookbacks, max_atr=spec.max_atr, worst=spec.worst))
    averages = scored.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])
    return WalkForward(windows, results, chosen, best.select(*wk, *METRICS), scored, averages)


def train_vs_test(run: WalkForward, metric: str, keys: list[str] = SERIES) -> DataFrame:
    wk = [*keys, "window_id"]
    a = run.train.select(*wk, F.col(metric).alias("train"))
    return a.join(run.test.select(*wk, F.col(metric).alias("test")), wk)


def combined_curve_metrics(curves: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Metrics of the test curves laid end to end (window_id, bar_idx, equity and the account's own ret).

    ``ret`` is exactly zero while an account is idle; where it is NULL, as on a window's first bar, the
    return is against the last bar of the window before.
    """
    offsets = curves.groupBy(*keys, "window_id").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    offsets = offsets.select(
        *keys, "window_id",
        F.coalesce(F.sum("_n").over(w.orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(w).alias("n_bars"), F.count(F.lit(1)).over(w).alias("n_windows"),
    )
    curves = curves.withColumnRenamed("ret", "_own") if "ret" in curves.columns else curves.withColumn("_own", F.lit(None).cast("double"))
    d = curves.drop("n_bars", "chunk").join(offsets, [*keys, "window_id"]).withColumn("bar_idx", F.col("_off") + F.col("bar_idx"))
    d = mt.with_drawdown(mt.with_returns(d, keys=keys), keys=keys)
    d = d.withColumn("ret", F.coalesce("_own", "ret"))
    year = F.sqrt(F.lit(float(HOURS_PER_YEAR)))
    down = F.when(F.col("ret") < 0, F.col("ret"))
    first, last = F.min_by("equity", "bar_idx"), F.max_by("equity", "bar_idx")
    has = F.count("ret") > 0
    return d.groupBy(*keys).agg(
        ((last - first) / first).alias("total_return"),
        (last / first - 1).alias("cumulative_return"),
        mt.annualised(last / first, F.count(F.lit(1))).alias("annualized_return"),
        F.when(has, F.avg("ret") / (F.stddev_samp("ret") + 1e-10) * year).otherwise(0.0).alias("sharpe_ratio"),
        F.when(~has, 0.0).when(F.count(down) == 0, F.expr(mt.INF)).otherwise(
            F.avg("ret") / (F.stddev_samp(down) + 1e-10) * year
        ).alias("sortino_ratio"),
        *[c.alias(n) for n, c in mt.max_drawdown_columns().items()],
        F.max("n_windows").alias("n_windows"),
    )
