"""Block bootstrap of return series and the metrics of simulated curves.

Series x simulation is the parallel axis.  One simulated curve is as long as its series, so windows
over (keys, sim_id) stay small and even however uneven the series are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import each
from tidemark.functions.draws import below
from tidemark.operators import metrics as mt, series
from tidemark.operators.smooth import whole_chunks
from tidemark.schema import HOURS_PER_YEAR, SERIES

MC_METRICS = ["total_return", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "annualized_return"]
PERCENTILES = [5, 25, 50, 75, 95]


def _lengths(d: DataFrame, block: int, keys: list[str]) -> DataFrame:
    """Series length, block size and number of blocks; a size <= 0 means int(sqrt(n))."""
    size = F.lit(block) if block > 0 else F.greatest(F.lit(1), F.floor(F.sqrt("n")))
    lengths = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("size", size.cast("long"))
    return lengths.withColumn("_blocks", F.ceil(F.col("n") / F.col("size")))


def _drawn_blocks(d: DataFrame, n_sims: int, block: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys, sim_id, block_no, start, size, n): ceil(n / block) block starts per simulation."""
    # spread the (series, simulation) pairs before they grow into blocks
    sims = _lengths(d, block, keys).withColumn("sim_id", each(0, n_sims - 1)).repartition(*keys, "sim_id")
    drawn = sims.withColumn("block_no", each(0, F.col("_blocks") - 1))
    choices = F.greatest(F.lit(1), F.col("n") - F.col("size") + 1)
    start = below(choices, F.col("sim_id") * F.col("_blocks") + F.col("block_no"), 0, seed)
    return drawn.withColumn("start", start).drop("_blocks")


def block_bootstrap(
    df: DataFrame, value: str = "ret", n_sims: int = 1000, block: int = 20, seed: int = 0, keys: list[str] = SERIES
) -> DataFrame:
    """Resampled series (keys, sim_id, pos, value) built from blocks of consecutive values.

    ``df`` holds keys, ``idx`` (0-based, dense) and the value; simulations are cut to the original
    length.
    """
    d = df.select(*keys, "idx", value)
    drawn = _drawn_blocks(d, n_sims, block, seed, keys).withColumn("_o", each(0, F.col("size") - 1))
    taken = drawn.select(
        *keys, "sim_id", (F.col("block_no") * F.col("size") + F.col("_o")).alias("pos"),
        (F.col("start") + F.col("_o")).alias("idx"), "n",
    )
    return taken.where(F.col("pos") < F.col("n")).join(d, [*keys, "idx"]).select(*keys, "sim_id", "pos", value)


_BLOCK = "g double, top double, low double, fall double, peak double, s1 double, s2 double, dn long, d1 double, d2 double, dmin double, dmax double"
#: Numbers of a strided view worked on at once.
_AT_ONCE = 1 << 20


def _block_metrics(df: DataFrame, value: str, block: int, keys: list[str]) -> DataFrame:
    """(keys, start, len, mean, ...) for every start of a block, at full length and at that of the last block.

    Chunks of starts with the bars that their blocks reach into, each one a strided view: a bar is a row of one or two
    chunks, not of every block that holds it.
    """
    r = F.col(value).cast("double")
    means = df.groupBy(*keys).agg(F.avg(r).alias("mean"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("_down"))
    d = df.select(*keys, "idx", r.alias("_r")).join(_lengths(df, block, keys).join(means, keys), keys)
    d = d.withColumns({"_len": F.least("size", "n"), "_rest": F.col("n") - (F.col("_blocks") - 1) * F.col("size")})
    d = d.withColumn("_width", F.greatest(F.lit(series.CHUNK_BARS).cast("long"), 4 * F.col("_len")))
    first = F.greatest(F.lit(0), F.expr("CAST(floor((idx - _len + 1) / _width) AS BIGINT)"))
    laid = d.withColumn("_chunk", F.explode(F.sequence(first, F.expr("idx div _width")))).drop("size", "_blocks")
    named = ", ".join(f"`{k}` {laid.schema[k].dataType.simpleString()}" for k in keys)
    cell = [*keys, "_chunk"]
    names = ["start", "len", "mean", *(part.split()[0] for part in _BLOCK.split(", "))]

    def told(w: np.ndarray, mean: float, down: float) -> list[np.ndarray]:
        g = np.cumprod(1 + w, axis=1)
        top = np.maximum.accumulate(g, axis=1)
        fall = g - top
        at = fall.argmin(1)[:, None]
        worst = [np.take_along_axis(x, at, 1)[:, 0] for x in (fall, top)]
        off, below = w - mean, w < 0
        lower = np.where(below, w - down, 0)
        return [g[:, -1], top[:, -1], g.min(1), *worst, off.sum(1), (off * off).sum(1), below.sum(1), lower.sum(1), (lower * lower).sum(1),
                np.where(below, w, np.inf).min(1), np.where(below, w, -np.inf).max(1)]

    def kernel(batches):
        for table in whole_chunks(batches, cell):
            values, here = table["_r"].to_numpy(), int(table["idx"][0].as_py())
            one = {name: table[name][0].as_py() for name in ("n", "_len", "_rest", "_width", "_chunk", "mean", "_down")}
            begin = one["_chunk"] * one["_width"]
            starts = np.arange(begin, min(begin + one["_width"], one["n"] - one["_len"] + 1))
            for length in {one["_len"], one["_rest"]}:
                if not len(starts):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(values, length)
                for a in range(0, len(starts), max(1, _AT_ONCE // length)):
                    some = starts[a : a + max(1, _AT_ONCE // length)]
                    columns = told(view[some - here], one["mean"], one["_down"])
                    columns[-2:] = [pa.array(c, mask=~np.isfinite(c)) for c in columns[-2:]]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.repeat(table[k][0], len(some)) for k in keys], pa.array(some), pa.array(np.full(len(some), length)),
                         pa.array(np.full(len(some), one["mean"])), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]],
                        names=[*keys, *names])

    return laid.repartition(*cell).sortWithinPartitions(*cell, "idx").mapInArrow(kernel, f"{named}, start long, len long, mean double, {_BLOCK}")


def bootstrap_metrics(
    df: DataFrame, initial: float, capital: float = 10000.0, value: str = "ret", n_sims: int = 1000,
    block: int = 20, seed: int = 0, keys: list[str] = SERIES,
) -> DataFrame:
    """``curve_metrics(block_bootstrap(...))`` without ever building the simulated curves.

    A block is fully described by its growth, sums, lowest point and deepest fall, which are computed once per
    possible start; a simulation is then a window over its blocks, ``block`` times fewer rows than its bars.
    Sums are of deviations from the series' mean. Values are not null.
    """
    drawn = _drawn_blocks(df.select(*keys, "idx", value), n_sims, block, seed, keys)
    drawn = drawn.withColumn("len", F.least(F.col("size"), F.col("n") - F.col("block_no") * F.col("size")))
    cells = [*keys, "start", "len"]
    blocks = _block_metrics(df, value, block, keys)

    sim = [*keys, "sim_id"]
    order = Window.partitionBy(*sim).orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    p = drawn.join(blocks, cells)
    p = p.withColumn("_e", initial * F.coalesce(F.product("g").over(before), F.lit(1.0)))
    p = p.withColumn("_top", F.greatest(F.lit(float(initial)), F.max(F.col("_e") * F.col("top")).over(before)))
    # either below the peak reached earlier, or below the block's own
    old = F.struct((F.col("_e") * F.col("low") - F.col("_top")).alias("drawdown"), F.col("block_no"), F.col("_top").alias("peak"))
    own = F.struct((F.col("_e") * F.col("fall")).alias("drawdown"), F.col("block_no"), (F.col("_e") * F.col("peak")).alias("peak"))
    worst = F.min(F.least(old, own))

    def deviation(n: Column, total: Column, squares: Column) -> Column:
        spread = F.greatest(squares - total * total / n, F.lit(0.0))
        return F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1)))

    year = F.sqrt(F.lit(float(HOURS_PER_YEAR)))
    last, n = F.max_by(F.col("_e") * F.col("g"), "block_no"), F.max("n")
    s1, s2, dn, d1, d2 = (F.sum(c) for c in ("s1", "s2", "dn", "d1", "d2"))
    mean = F.max("mean") + s1 / n
    flat = F.min("dmin") == F.max("dmax")
    down_sd = F.when(flat & (dn > 1), 0.0).otherwise(deviation(dn, d1, d2))
    return p.groupBy(*sim).agg(
        ((last - capital) / capital).alias("total_return"),
        F.when(n > 1, mean / (deviation(n, s1, s2) + 1e-10) * year).otherwise(0.0).alias("sharpe_ratio"),
        F.when(n <= 1, 0.0).when(dn == 0, F.expr(mt.INF)).otherwise(mean / (down_sd + 1e-10) * year).alias("sortino_ratio"),
        F.when(worst["peak"] > 0, worst["drawdown"] / worst["peak"]).otherwise(0.0).alias("max_drawdown_pct"),
        mt.annualised(last / capital, n + 1).alias("annualized_return"),
    )


def residual_bootstrap(
    df: DataFrame, n_sims: int = 1000, block: int = 20, seed: int = 0, keys: list[str] = SERIES,
    x: str = "close", smoothed: str = "smoothed",
) -> DataFrame:
    """Synthetic prices: the smooth line plus resampled residuals."""
    d = df.select(*keys, F.col("bar_idx").alias("idx"), smoothed, (F.col(x) - F.col(smoothed)).alias("_res"))
    resampled = block_bootstrap(d.where(F.col("_res").isNotNull()), "_res", n_sims, block, seed, keys)
    line = d.select(*keys, F.col("idx").alias("pos"), smoothed)
    return resampled.join(line, [*keys, "pos"]).select(
        *keys, "sim_id", "pos", (F.col(smoothed) + F.col("_res")).alias("price")
    )


def simulated_curves(
    returns: DataFrame, initial: Column | float, value: str = "ret", keys: list[str] = SERIES
) -> DataFrame:
    """Compounded curves of bootstrapped returns: (keys, sim_id, bar_idx, ret, equity), n + 1 points."""
    start = F.lit(float(initial)) if not isinstance(initial, Column) else initial
    origin = returns.where(F.col("pos") == 0).withColumn("pos", F.lit(-1).cast("long")).withColumn(value, F.lit(None).cast("double"))
    w = Window.partitionBy(*keys, "sim_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w)
    both = returns.unionByName(origin)
    return both.withColumn("equity", start * growth).withColumn("bar_idx", F.col("pos") + 1).drop("pos")


def curve_metrics(
    returns: DataFrame, initial: float, capital: float = 10000.0, value: str = "ret", keys: list[str] = SERIES
) -> DataFrame:
    """Five metrics per simulation, straight from the bootstrapped returns.

    Growth, running peak and the aggregate share one shuffle by (keys, sim_id).
    """
    group = [*keys, "sim_id"]
    w = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("equity", F.lit(float(initial)) * F.product(1 + F.col(value)).over(w))
    d = d.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(float(initial))))
    d = d.withColumn("drawdown", F.col("equity") - F.col("peak"))
    year = F.sqrt(F.lit(float(HOURS_PER_YEAR)))
    down = F.when(F.col(value) < 0, F.col(value))
    last, n = F.max_by("equity", "pos"), F.count(F.lit(1))
    return d.groupBy(*group).agg(
        ((last - capital) / capital).alias("total_return"),
        F.when(n > 1, F.avg(value) / (F.stddev_samp(value) + 1e-10) * year).otherwise(0.0).alias("sharpe_ratio"),
        F.when(n <= 1, 0.0).when(F.count(down) == 0, F.expr(mt.INF)).otherwise(
            F.avg(value) / (F.stddev_samp(down) + 1e-10) * year
        ).alias("sortino_ratio"),
        mt.max_drawdown_columns("pos")["max_drawdown_pct"].alias("max_drawdown_pct"),
        mt.annualised(last / capital, n + 1).alias("annualized_return"),
    )


def metric_distribution(per_sim: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return per_sim.unpivot([*keys, "sim_id"], MC_METRICS, "metric", "value")


def summarise(per_sim: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Percentiles, mean and deviation per metric over the finite values."""
    long = metric_distribution(per_sim, keys)
    finite = long.where(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    s = finite.groupBy(*keys, "metric").agg(
        F.percentile("value", F.array(*[F.lit(p / 100) for p in PERCENTILES])).alias("_p"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    cols = [F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
    return s.select(*keys, "metric", *cols, "mean", "std")


def histogram(per_sim: DataFrame, bins: int = 50, keys: list[str] = SERIES) -> DataFrame:
    """Counts in equal bins between the smallest and largest finite value of each metric."""
    long = metric_distribution(per_sim, keys)
    long = long.where(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    edges = long.groupBy(*keys, "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = long.join(edges, [*keys, "metric"])
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.5)) * bins))
    return d.withColumn("bin", at.cast("long")).groupBy(*keys, "metric", "bin").agg(F.count(F.lit(1)).alias("n"))
