"""Low-pass smoothing of price series with a cosine transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.transform import dft, has_long_series, long_series
from tidemark.plans.staging import stage
from tidemark.schema import SERIES

TAPER = 0.1
PADDING = 0.2


def cosine_gain(n: int, cutoff: float, taper: float = TAPER) -> np.ndarray:
    """Unit gain below the cut-off bin, half-cosine roll-off, then zero."""
    return gain_at(np.arange(n), n, cutoff, taper)


def gain_at(k: np.ndarray, n: int, cutoff: float, taper: float = TAPER) -> np.ndarray:
    """``cosine_gain`` of the bins ``k`` alone."""
    edge = int(cutoff * n)
    width = max(1, int(taper * edge))
    k = k - edge
    if edge + width >= n:
        return (k < 0).astype(float)
    return np.where(k < 0, 1.0, np.where(k < width, 0.5 + 0.5 * np.cos(np.pi * k / width), 0.0))


def low_pass(x: np.ndarray, cutoff: float, taper: float = TAPER, padding: float = PADDING) -> np.ndarray:
    """Mirror-pad, transform, damp, transform back, crop.

    The orthonormal cosine transform is one complex FFT of the even/odd reordering of the samples.
    """
    return low_pass_many(x, [cutoff], taper, padding)[0]


def low_pass_many(x: np.ndarray, cutoffs: list[float], taper: float = TAPER, padding: float = PADDING) -> np.ndarray:
    """cutoffs x samples: one transform of the series, damped and brought back for every cut-off."""
    n = len(x)
    pad = int(n * padding)
    wide = np.pad(x, pad, mode="reflect") if pad else x
    m = len(wide)
    twist = np.exp(-0.5j * np.pi * np.arange(m) / m)
    whole = (np.fft.fft(np.concatenate([wide[::2], wide[1::2][::-1]])) * twist).real
    out = np.empty((len(cutoffs), n))
    for row, cutoff in zip(out, cutoffs):
        spectrum = whole * cosine_gain(m, cutoff, taper)
        mirrored = np.concatenate([[0.0], spectrum[:0:-1]])
        folded = np.fft.ifft((spectrum - 1j * mirrored) / twist).real
        back = np.empty(m)
        back[::2] = folded[: (m + 1) // 2]
        back[1::2] = folded[(m + 1) // 2 :][::-1]
        row[:] = back[pad : pad + n]
    return out


def whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup Arrow batches sorted by (keys, bar_idx) into tables of complete series.

    A series starts where ``bar_idx`` is 0.  Only the series at hand is held back, so a partition
    with many series streams through.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("bar_idx").to_numpy() == 0)
        if len(starts) == 0:
            held.append(batch)
            continue
        last = int(starts[-1])
        held.append(batch.slice(0, last))
        ready = pa.Table.from_batches(held)
        if ready.num_rows:
            yield ready.combine_chunks()
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_chunks(batches: Iterator[pa.RecordBatch], cell: list[str]) -> Iterator[pa.Table]:
    """Regroup Arrow batches sorted by ``cell`` into one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in cell:
            c = batch.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1].column(name)[-1] != batch.column(name)[0] for name in cell)
        cuts = np.flatnonzero(new)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a in cuts and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def smooth(
    df: DataFrame,
    cutoff: Column,
    x: str = "close",
    name: str = "smoothed",
    keys: list[str] = SERIES,
    taper: float = TAPER,
    padding: float = PADDING,
) -> DataFrame:
    """Add the low-passed ``x`` of every series; ``cutoff`` is a per-series column expression.

    A series of up to ``transform.long_series()`` bars is one task's work, and all its other columns pass through as
    Arrow buffers; longer ones are spread over tasks (``smooth_long``).
    """
    if "n_bars" in df.columns and has_long_series(df):
        short = smooth_short(df.where(F.col("n_bars") <= long_series()), cutoff, x, name, keys, taper, padding)
        return short.unionByName(smooth_long(df.where(F.col("n_bars") > long_series()), cutoff, x, name, keys, taper, padding))
    return smooth_short(df, cutoff, x, name, keys, taper, padding)


def smooth_short(df: DataFrame, cutoff: Column, x: str, name: str, keys: list[str], taper: float = TAPER, padding: float = PADDING) -> DataFrame:
    d = df.withColumn("_cutoff", cutoff)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            starts = np.flatnonzero(table.column("bar_idx").to_numpy() == 0)
            values, cuts = table.column(x).to_numpy(), table.column("_cutoff").to_numpy()
            lines = [
                low_pass(values[a:b], float(cuts[a]), taper, padding)
                for a, b in zip(starts, [*starts[1:], len(values)])
            ]
            out = table.drop_columns("_cutoff").append_column(name, pa.array(np.concatenate(lines)))
            yield from out.to_batches()

    return d.repartition(*keys).sortWithinPartitions(*keys, "bar_idx").mapInArrow(kernel, schema)


def smooth_long(df: DataFrame, cutoff: Column, x: str, name: str, keys: list[str], taper: float = TAPER, padding: float = PADDING) -> DataFrame:
    """``smooth_short`` for series of any length: no task holds more than a block of one.

    The even/odd reordering of the padded samples goes through ``transform.dft`` and, damped, through it once
    more; of the coefficients only those that the gain keeps are handed on.
    """
    n = F.col("n_bars")
    shape = df.where(F.col("bar_idx") == 0).select(*keys, n, cutoff.alias("_cut"), F.floor(n * padding).alias("_pad"))
    shape = stage(shape.withColumn("m", F.col("n_bars") + 2 * F.col("_pad")))
    names = [*keys, "n_bars", "_cut", "_pad", "m"]

    # a bar sits at its own padded position and, near an end, at its mirror image
    d = df.select(*keys, "bar_idx", F.col(x).alias("re")).join(shape, keys)
    i, pad = F.col("bar_idx"), F.col("_pad")
    places = F.array(
        i + pad, F.when((i >= 1) & (i <= pad), pad - i), F.when((i <= n - 2) & (i >= n - 1 - pad), pad + 2 * (n - 1) - i)
    )
    j = F.col("_j")
    samples = d.withColumn("_j", F.explode(F.filter(places, lambda p: p.isNotNull()))).select(
        *names, F.when(j % 2 == 0, F.expr("_j div 2")).otherwise(F.expr("m - 1 - (_j - 1) div 2")).alias("t"), "re", F.lit(0.0).alias("im"))

    def damp(told: dict, k: np.ndarray, line: np.ndarray) -> dict:
        """Conjugates of the coefficients to bring back: each goes to its own place and, turned, to its mirror."""
        m = told["m"]
        gain = gain_at(k, m, told["_cut"], taper)
        k, line, gain = k[gain > 0], line[gain > 0], gain[gain > 0]
        kept = (line * np.exp(-0.5j * np.pi * k / m)).real * gain
        there = m - k[k > 0]
        back = np.concatenate([kept * np.exp(-0.5j * np.pi * k / m), 1j * kept[k > 0] * np.exp(-0.5j * np.pi * there / m)])
        return {"t": pa.array(np.concatenate([k, there])), "re": pa.array(back.real), "im": pa.array(back.imag)}

    def crop(told: dict, k: np.ndarray, line: np.ndarray) -> dict:
        m, half = told["m"], (told["m"] + 1) // 2
        at = np.where(k < half, 2 * k, 2 * (m - 1 - k) + 1) - told["_pad"]
        inside = (at >= 0) & (at < told["n_bars"])
        return {"bar_idx": pa.array(at[inside]), name: pa.array(line.real[inside] / m)}

    kept = dft(samples, shape, names, damp, "t long, re double, im double")
    line = dft(kept, shape, names, crop, f"bar_idx long, `{name}` double")
    return df.join(line.select(*keys, "bar_idx", name), [*keys, "bar_idx"])


def exponential_means(x: np.ndarray, spans: list[int]) -> np.ndarray:
    """samples x spans: y0 = x0, y = a*x + (1-a)*y_prev with a = 2/(span+1); all spans step together."""
    weight = 2.0 / (np.asarray(spans, float) + 1.0)
    out = np.empty((len(x), len(spans)))
    state = np.full(len(spans), x[0])
    for i, value in enumerate(x):
        state = state + weight * (value - state)
        out[i] = state
    return out


def smooth_for_candidates(
    df: DataFrame, shapes: list[tuple[int, float]], spans: list[int], keys: list[str] = SERIES, x: str = "close", tr: str = "tr",
) -> DataFrame:
    """Add ``lines``, the low-passed ``x`` for every (period in bars, scale) of ``shapes``, and ``ranges``,
    the exponential mean of ``tr`` for every span: each computed once however many candidates share it.

    A period of zero bars or less smooths nothing.
    """
    many = T.ArrayType(T.DoubleType())
    schema = T.StructType([*df.schema.fields, T.StructField("lines", many), T.StructField("ranges", many)])

    def listed(values: np.ndarray) -> pa.ListArray:
        n, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            starts = np.flatnonzero(table.column("bar_idx").to_numpy() == 0)
            values, spread = table.column(x).to_numpy(), table.column(tr).to_numpy()
            for a, b in zip(starts, [*starts[1:], len(values)]):
                n = b - a
                cuts = [min((n / p) * scale / (n / 2.0), 1.0) if p > 0 else 1.0 for p, scale in shapes]
                part = table.slice(a, n).append_column("lines", listed(low_pass_many(values[a:b], cuts).T))
                yield from part.append_column("ranges", listed(exponential_means(spread[a:b], spans))).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, "bar_idx").mapInArrow(kernel, schema)
