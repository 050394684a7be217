"""Parameter candidates: grids, random draws and Gaussian-process suggestions."""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, log10, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import each
from tidemark.functions.draws import uniform


@dataclass(frozen=True)
class Axis:
    """One parameter: an int or float range, or a list of choices."""

    kind: str  # "int", "float" or "choice"
    low: float = 0.0
    high: float = 0.0
    log: bool = False
    choices: tuple = ()

    def __post_init__(self):
        if self.kind not in ("int", "float", "choice"):
            raise ValueError(f"unknown axis kind {self.kind!r}")
        if self.kind == "choice" and not self.choices:
            raise ValueError("a choice axis needs choices")
        if self.kind != "choice" and self.low >= self.high:
            raise ValueError("low must be below high")
        if self.log and self.low <= 0:
            raise ValueError("a log axis needs a positive low end")

    def points(self, n: int) -> list:
        """Evenly spaced grid values (whole numbers truncate; log spacing only for floats)."""
        if self.kind == "choice":
            return list(self.choices)
        if self.kind == "float" and self.log:
            return [float(10**v) for v in np.linspace(log10(self.low), log10(self.high), n)]
        values = np.linspace(self.low, self.high, n)
        return [int(v) for v in values] if self.kind == "int" else [float(v) for v in values]

    def draw(self, u: Column) -> Column:
        """Map a uniform draw to a value."""
        if self.kind == "choice":
            return F.element_at(F.array(*[F.lit(c) for c in self.choices]), (F.floor(u * len(self.choices)) + 1).cast("int"))
        if self.kind == "int":
            return (self.low + F.floor(u * (self.high - self.low + 1))).cast("int")
        return self.place(u)

    def place(self, u: Column) -> Column:
        """Map a normalised coordinate in [0, 1] to a value (whole numbers truncate)."""
        if self.kind == "choice":
            last = len(self.choices) - 1
            at = F.least(F.floor(u * last + 0.5), F.lit(last)) + 1
            return F.element_at(F.array(*[F.lit(c) for c in self.choices]), at.cast("int"))
        if self.log:
            value = F.pow(F.lit(10.0), u * (log10(self.high) - log10(self.low)) + log10(self.low))
        else:
            value = u * (self.high - self.low) + self.low
        return value.cast("int") if self.kind == "int" else value

    def coordinate(self, value: Column) -> Column:
        """Normalise a value to [0, 1]."""
        if self.kind == "choice":
            if len(self.choices) == 1:
                return F.lit(0.5)
            at = F.array_position(F.array(*[F.lit(c) for c in self.choices]), value) - 1
            return at / float(len(self.choices) - 1)
        if self.log:
            return (F.log10(value) - log10(self.low)) / (log10(self.high) - log10(self.low))
        return (value - self.low) / (self.high - self.low)


Space = dict[str, Axis]

# The default strategy space.
DEFAULT_SPACE: Space = {
    "min_trend_period_hours": Axis("float", 12.0, 168.0),
    "cutoff_scale": Axis("float", 0.5, 2.0),
    "atr_period": Axis("int", 7, 28),
    "k_stop": Axis("float", 1.0, 4.0),
    "k_profit": Axis("float", 2.0, 6.0),
    "slope_threshold": Axis("float", 0.0, 0.001),
    "slope_lookback": Axis("int", 1, 5),
}


def grid_size(space: Space, points: int) -> int:
    size = 1
    for axis in space.values():
        size *= len(axis.points(points))
    return size


def grid_columns(space: Space, points: int, param_id: Column) -> dict[str, Column]:
    """Grid values by mixed-radix digits of the candidate number; the last parameter turns fastest."""
    columns, stride = {}, 1
    for name, axis in reversed(space.items()):
        values = axis.points(points)
        digit = F.floor(param_id / stride) % len(values)
        columns[name] = F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int"))
        stride *= len(values)
    return {name: columns[name] for name in space}


def random_columns(space: Space, param_id: Column, seed: int) -> dict[str, Column]:
    return {name: axis.draw(uniform(param_id, i, seed)) for i, (name, axis) in enumerate(space.items())}


def with_candidates(df: DataFrame, n: int, columns: dict[str, Column]) -> DataFrame:
    """Every row once per candidate; parameters are computed from ``param_id``, nothing is joined."""
    out = df.withColumn("param_id", each(0, n - 1))
    return out.withColumns(columns)


def grid_candidates(df: DataFrame, space: Space, points: int = 5) -> DataFrame:
    return with_candidates(df, grid_size(space, points), grid_columns(space, points, F.col("param_id")))


def random_candidates(df: DataFrame, space: Space, n: int = 100, seed: int = 0) -> DataFrame:
    return with_candidates(df, n, random_columns(space, F.col("param_id"), seed))


# --- Gaussian process ---------------------------------------------------------------------------

def posterior(x: np.ndarray, y: np.ndarray, at: np.ndarray, scale: float = 0.3, noise: float = 1e-5):
    """Mean and deviation at each row of ``at``: unit prior, squared-exponential kernel."""

    def kernel(a, b):
        gaps = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return np.exp(-0.5 * gaps / scale**2)

    if len(x) == 0:
        return np.zeros(len(at)), np.ones(len(at))
    cross = kernel(at, x)
    try:
        solved = np.linalg.solve(kernel(x, x) + noise * np.eye(len(x)), np.column_stack([y, cross.T]))
    except np.linalg.LinAlgError:
        return np.full(len(at), y.mean()), np.ones(len(at))
    mean = cross @ solved[:, 0]
    variance = 1.0 - (cross * solved[:, 1:].T).sum(axis=1)
    return mean, np.sqrt(np.maximum(variance, 1e-10))


def acquisition(mean, deviation, best: float, kind: str = "ei", kappa: float = 2.576, xi: float = 0.01):
    """Expected improvement, upper confidence bound, probability of improvement, or the mean."""
    if kind == "ucb":
        return mean + kappa * deviation
    if kind not in ("ei", "poi"):
        return mean
    gain = mean - best - xi
    z = gain / (deviation + 1e-10)
    below = np.array([0.5 * erfc(-v / sqrt(2.0)) for v in z])  # exact in the tail, where small gains are compared
    if kind == "poi":
        return below
    return gain * below + deviation * np.exp(-0.5 * z**2) / sqrt(2.0 * pi)


def suggest(
    observed: DataFrame, space: Space, keys: list[str], n_iter: int = 50, seed: int = 0, kind: str = "ei",
    kappa: float = 2.576, xi: float = 0.01, samples: int = 100,
) -> DataFrame:
    """One batch of ``n_iter`` suggestions per key, each the best of ``samples`` random points.

    ``observed``: keys, the space's columns and ``score`` (higher is better).  Both sides of the
    cogroup are bounded by the settings (observations and n_iter * samples points per key).
    """
    names = list(space)
    points = F.array(*[axis.coordinate(F.col(n)).cast("double") for n, axis in space.items()])
    seen = observed.select(*keys, points.alias("_x"), F.col("score").cast("double").alias("_y"))
    # fresh column identities: both sides of the cogroup come from the same frame
    slots = observed.select(*keys).distinct().toDF(*keys)
    slots = slots.withColumn("_point", each(0, n_iter * samples - 1))
    drawn = F.array(*[uniform(F.col("_point"), 1000 + i, seed) for i in range(len(names))])
    slots = slots.withColumn("_u", drawn)
    schema = T.StructType([*slots.schema.fields, T.StructField("_gain", T.DoubleType())])

    def score(candidates: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        usable = known[np.isfinite(known["_y"].to_numpy(float))]
        at = np.vstack(candidates["_u"].to_numpy())
        x = np.vstack(usable["_x"].to_numpy()) if len(usable) else np.empty((0, at.shape[1]))
        y = usable["_y"].to_numpy(float)
        mean, deviation = posterior(x, y, at)
        best = y.max() if len(y) else 0.0
        return candidates.assign(_gain=acquisition(mean, deviation, best, kind, kappa, xi))

    scored = slots.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(score, schema)
    picked = scored.groupBy(*keys, F.floor(F.col("_point") / samples).alias("slot")).agg(
        F.max_by("_u", F.struct("_gain", -F.col("_point"))).alias("_u"), F.max("_gain").alias("gain")
    )
    return picked.select(
        *keys, "slot", "gain", *[axis.place(F.col("_u")[i]).alias(n) for i, (n, axis) in enumerate(space.items())]
    )


# --- ranking and report tables ------------------------------------------------------------------

def best_result(results: DataFrame, metric: str, keys: list[str], maximize: bool = True) -> DataFrame:
    """First best candidate of each key."""
    score = F.col(metric)
    order = F.desc_nulls_last(score) if maximize else F.asc_nulls_last(score)
    w = Window.partitionBy(*keys).orderBy(order, "param_id")
    return results.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def leaderboard(results: DataFrame, params: list[str], metrics: list[str], metric: str, keys: list[str], maximize: bool = True) -> DataFrame:
    board = results.select(*keys, "param_id", *params, *[F.col(m).alias(f"train_{m}") for m in metrics])
    order = F.desc_nulls_last(f"train_{metric}") if maximize else F.asc_nulls_last(f"train_{metric}")
    return board.orderBy(order, *keys, "param_id")


def parameter_importance(board: DataFrame, params: list[str], metric: str, keys: list[str], top: int = 10) -> DataFrame:
    """Absolute correlation of each parameter with the metric; constant parameters drop out."""
    finite = F.when(F.abs(F.col(metric)) < float("inf"), F.col(metric))
    wide = board.groupBy(*keys).agg(*[F.abs(F.corr(F.col(p).cast("double"), finite)).alias(p) for p in params])
    long = wide.unpivot(keys, params, "parameter", "importance")
    known = long.where(F.col("importance").isNotNull() & ~F.isnan("importance"))
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), "parameter")
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def parameter_heatmap(board: DataFrame, x: str, y: str, metric: str, keys: list[str], x_values: list) -> DataFrame:
    return board.groupBy(*keys, y).pivot(x, x_values).agg(F.avg(metric))


def best_so_far(results: DataFrame, metric: str, keys: list[str], maximize: bool = True) -> DataFrame:
    """Running best by candidate number; missing scores carry the best forward."""
    w = Window.partitionBy(*keys).orderBy("param_id").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(metric) if maximize else F.min(metric)
    return results.select(*keys, "param_id", metric, best.over(w).alias("best"))


def frontier(board: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return board.select(*keys, "param_id", F.col(x).alias("x"), F.col(y).alias("y"))
