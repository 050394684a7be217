"""Fourier transforms of series too long for one task, of any length.

A transform of length m becomes a convolution with a chirp, whose length L can then be a power of two. L is laid
out as a matrix of N1 rows and N2 columns, and both are dealt in blocks: transforms of the columns, a turn of
each element, transforms of the rows and back, a turn, the columns back. Between these steps blocks are
transposed by a shuffle of tiles, each one binary value of complex numbers. No task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators import series

_TILE = "_tile binary, _chirp binary"


def block_size() -> int:
    """Complex numbers of a block."""
    return 64 * series.CHUNK_BARS


class _Plan:
    """The layout for length m: L = N1 * N2 elements, element i at row i // N2 and column i % N2."""

    def __init__(self, m: int, block: int):
        bits = max(1, int(2 * m - 2).bit_length())
        self.m, self.size = m, 1 << bits
        self.n2 = 1 << (bits - bits // 2)
        self.n1 = self.size // self.n2
        self.columns = max(1, min(self.n2, block // self.n1))
        self.rows = max(1, min(self.n1, block // self.n2))

    def wave(self, k: np.ndarray) -> np.ndarray:
        """exp(i pi k^2 / m), the phase taken exactly."""
        k = k.astype(np.int64)
        return np.exp(1j * np.pi * ((k * k) % (2 * self.m)) / self.m)

    def chirp(self, at: np.ndarray) -> np.ndarray:
        far = np.minimum(at, self.size - at)
        return np.where(far < self.m, self.wave(np.minimum(far, self.m)), 0)

    def turn(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * ((row[:, None] * column[None, :]) % self.size) / self.size)


def dft(
    samples: DataFrame, lengths: DataFrame, keys: list[str], finish: Callable[[dict, np.ndarray, np.ndarray], dict[str, np.ndarray]],
    out: str, block: int | None = None,
) -> DataFrame:
    """X[k] = sum over t of x[t] exp(-2 pi i k t / m) for each series.

    ``samples`` has ``keys``, t, re, im; samples of the same t are added up, missing ones are zero. ``keys`` name the
    series and include ``m``, its length; ``lengths`` has a row of them for every series. ``finish`` gets the keys'
    values, numbers k and their X, and returns the columns ``out`` to keep of them.
    """
    block = block or block_size()
    kept = T.StructType([f for f in lengths.schema.fields if f.name in keys])
    kept = T.StructType([kept[k] for k in keys])
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    # the layout of _Plan, told by columns
    bits = "length(bin(2 * m - 2))"
    n2 = F.expr(f"shiftleft(1L, CAST({bits} - {bits} div 2 AS INT))")
    width = F.expr(f"greatest(1L, least(shiftleft(1L, CAST({bits} - {bits} div 2 AS INT)), {block} div shiftleft(1L, CAST({bits} div 2 AS INT))))")
    groups = F.expr("sequence(0L, _n2 div _width - 1)")
    # each block of columns has a row at least: the chirp is made there
    seeds = lengths.select(*keys).withColumns({"_n2": n2, "_width": width}).withColumn("_g", F.explode(groups))
    seeds = seeds.select(*keys, (F.col("_g") * F.col("_width")).alias("t"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.col("_g").cast("int").alias("_columns"))
    placed = samples.select(*keys, F.col("t").cast("long").alias("t"), "re", "im").withColumns({"_n2": n2, "_width": width})
    placed = placed.withColumn("_columns", F.expr("CAST(t % _n2 div _width AS INT)")).drop("_n2", "_width").unionByName(seeds)

    def values_of(table: pa.Table) -> dict:
        return {k: table[k][0].as_py() for k in keys}

    def with_keys(told: dict, columns: dict, schema: list[str]) -> pa.Table:
        n = len(next(iter(columns.values())))
        full = {f.name: pa.array([told[f.name]] * n) if n < 1000 else pa.repeat(pa.scalar(told[f.name]), n) for f in kept.fields}
        return pa.table({name: (full | columns)[name] for name in schema})

    tiled = [*keys, "_rows", "_columns", "_tile", "_chirp"]

    def columns_there(table: pa.Table) -> pa.Table:
        told = values_of(table)
        plan = _Plan(told["m"], block)
        group = table["_columns"][0].as_py()
        column = np.arange(group * plan.columns, (group + 1) * plan.columns)
        t = table["t"].to_numpy()
        a = np.zeros((plan.n1, plan.columns), complex)
        x = (table["re"].to_numpy() + 1j * table["im"].to_numpy()) * plan.wave(t).conj()
        np.add.at(a, (t // plan.n2, t % plan.n2 - column[0]), x)
        b = plan.chirp(np.arange(plan.n1)[:, None] * plan.n2 + column)
        turn = plan.turn(np.arange(plan.n1), column)
        a, b = np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn
        rows = range(0, plan.n1, plan.rows)
        tiles = {"_rows": pa.array(range(len(rows)), pa.int32()), "_columns": pa.array([group] * len(rows), pa.int32()),
                 "_tile": pa.array([a[r : r + plan.rows].tobytes() for r in rows], pa.binary()),
                 "_chirp": pa.array([b[r : r + plan.rows].tobytes() for r in rows], pa.binary())}
        return with_keys(told, tiles, tiled)

    def assembled(table: pa.Table, name: str, at: str, shape: tuple[int, int], along: int) -> np.ndarray:
        """The tiles side by side, in their order along an axis."""
        whole = np.empty((len(table), *shape), complex)
        for place, tile in zip(table[at].to_pylist(), table[name].to_pylist()):
            whole[place] = np.frombuffer(tile, complex).reshape(shape)
        return np.concatenate(list(whole), axis=along)

    def rows_there_and_back(table: pa.Table) -> pa.Table:
        told = values_of(table)
        plan = _Plan(told["m"], block)
        group = table["_rows"][0].as_py()
        row = np.arange(group * plan.rows, (group + 1) * plan.rows)
        shape = (plan.rows, plan.columns)
        a, b = (assembled(table, name, "_columns", shape, 1) for name in ("_tile", "_chirp"))
        both = np.fft.ifft(np.fft.fft(a, axis=1) * np.fft.fft(b, axis=1), axis=1) * plan.turn(row, np.arange(plan.n2)).conj()
        columns = range(0, plan.n2, plan.columns)
        tiles = {"_rows": pa.array([group] * len(columns), pa.int32()), "_columns": pa.array(range(len(columns)), pa.int32()),
                 "_tile": pa.array([np.ascontiguousarray(both[:, c : c + plan.columns]).tobytes() for c in columns], pa.binary()),
                 "_chirp": pa.array([None] * len(columns), pa.binary())}
        return with_keys(told, tiles, tiled)

    names = [f.name for f in T._parse_datatype_string(out).fields]

    def columns_back(table: pa.Table) -> pa.Table:
        told = values_of(table)
        plan = _Plan(told["m"], block)
        group = table["_columns"][0].as_py()
        column = np.arange(group * plan.columns, (group + 1) * plan.columns)
        x = np.fft.ifft(assembled(table, "_tile", "_rows", (plan.rows, plan.columns), 0), axis=0)
        k = np.arange(plan.n1)[:, None] * plan.n2 + column
        inside = k < plan.m
        k, x = k[inside], x[inside]
        return with_keys(told, finish(told, k, x * plan.wave(k).conj()), [*keys, *names])

    there = placed.groupBy(*keys, "_columns").applyInArrow(columns_there, f"{named}, _rows int, _columns int, {_TILE}")
    turned = there.groupBy(*keys, "_rows").applyInArrow(rows_there_and_back, f"{named}, _rows int, _columns int, {_TILE}")
    return turned.groupBy(*keys, "_columns").applyInArrow(columns_back, f"{named}, {out}")


def long_series() -> int:
    """Longer series are spread over tasks."""
    return 16 * series.CHUNK_BARS


def has_long_series(df: DataFrame) -> bool:
    """One number from the driver: whether any series is to be spread. Needs ``n_bars``."""
    return (df.agg(F.max("n_bars")).first()[0] or 0) > long_series()
