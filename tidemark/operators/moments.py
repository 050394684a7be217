"""Moments of all pairs of members, from matrices of bars x members.

A chunk of bars of a portfolio is one matrix; products of it with itself give, for every pair of members, the
number of bars both have and the sums over those bars. A pair is one row for each chunk, never one for each bar, and
chunks are added with map-side combine. Values are taken relative to their member's mean, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from tidemark.operators.smooth import whole_chunks

#: Bars of a chunk.
CHUNK_TIMES = 1024
_SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def pair_moments(returns: DataFrame, keys: list[str], value: str = "ret", at: str = "t") -> DataFrame:
    """(keys, sym_i, sym_j, n, x, y, xx, yy, xy) for sym_i <= sym_j: count and sums over the bars where both have a value.

    ``returns`` has keys, symbol, ``at`` (whole numbers, one row for each member and bar) and ``value``.
    """
    known = returns.where(F.col(value).isNotNull()).select(*keys, "symbol", F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"))
    means = known.groupBy(*keys, "symbol").agg(F.avg("_v").alias("_mean"))
    d = known.join(means, [*keys, "symbol"]).select(
        *keys, "symbol", "_t", (F.col("_v") - F.col("_mean")).alias("_v"), F.floor(F.col("_t") / CHUNK_TIMES).alias("_chunk"))
    named = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    cell = [*keys, "_chunk"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_chunks(batches, cell):
            members = table["symbol"].combine_chunks().dictionary_encode()
            names = members.dictionary.take(pc.sort_indices(members.dictionary))
            column = pc.index_in(table["symbol"].combine_chunks(), names).to_numpy()
            times, row = np.unique(table["_t"].to_numpy(), return_inverse=True)
            values = np.zeros((len(times), len(names)))
            there = np.zeros_like(values)
            values[row, column], there[row, column] = table["_v"].to_numpy(), 1.0
            squares = values * values
            n, x, xx, xy = there.T @ there, values.T @ there, squares.T @ there, values.T @ values
            i, j = np.triu_indices(len(names))
            some = n[i, j] > 0
            i, j = i[some], j[some]
            sums = [n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.repeat(table[k][0], len(i)) for k in keys], names.take(pa.array(i)), names.take(pa.array(j)), *map(pa.array, sums)],
                names=[*keys, "sym_i", "sym_j", *_SUMS])

    parts = d.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        multiply, f"{named}, sym_i string, sym_j string, " + ", ".join(f"{s} double" for s in _SUMS))
    return parts.groupBy(*keys, "sym_i", "sym_j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _spread(square: str, total: str) -> Column:
    """Sum of squared deviations; what is left of a constant by rounding is zero."""
    left = F.col(square) - F.col(total) * F.col(total) / F.col("n")
    return F.when(left > 1e-12 * F.col(square), left).otherwise(0.0)


def sample_covariance() -> Column:
    """Of rows of ``pair_moments``; NULL with fewer than two common bars."""
    return F.when(F.col("n") > 1, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1))


def pearson(min_periods: int) -> Column:
    """Of rows of ``pair_moments``; NULL with too few common bars or where a member stands still."""
    both = F.sqrt(_spread("xx", "x")) * F.sqrt(_spread("yy", "y"))
    rho = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.nullif(both, F.lit(0.0)))
    return F.when(F.col("n") >= min_periods, rho)


def correlation_of(x: str, y: str, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation of two columns, NULL where one stands still (``F.corr`` is an error there)."""
    over = (lambda c: c.over(frame)) if frame is not None else (lambda c: c)
    both = over(F.stddev_pop(x)) * over(F.stddev_pop(y))
    return F.try_divide(over(F.covar_pop(x, y)), F.nullif(both, F.lit(0.0)))
