"""Spectra: of whole series, and of windows that slide over chunks of bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.operators import series
from tidemark.operators.series import chunk_window, drop_halo, lay_out
from tidemark.operators.smooth import whole_chunks, whole_series
from tidemark.operators.transform import dft, has_long_series, long_series
from tidemark.plans.staging import stage
from tidemark.schema import SERIES


def fft_spectrum(
    df: DataFrame, x: str = "close", keys: list[str] = SERIES, sampling_rate: float = 1.0
) -> DataFrame:
    """Power |FFT|^2 of the mean-centred series at its strictly positive frequencies.

    Series longer than ``transform.long_series()`` are spread over tasks.
    """
    if "n_bars" in df.columns and has_long_series(df):
        d, long = df.where(F.col("n_bars") <= long_series()), df.where(F.col("n_bars") > long_series())
        return _spectrum(d, x, keys, sampling_rate).unionByName(_long_spectrum(long, x, keys, sampling_rate))
    return _spectrum(df, x, keys, sampling_rate)


_LINES = "k long, freq double, power double"


def _spectrum(df: DataFrame, x: str, keys: list[str], sampling_rate: float) -> DataFrame:
    """One task takes a whole series at a time, however many it has."""
    d = df.select(*keys, "bar_idx", F.col(x).cast("double").alias(x))
    named = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches):
            starts = np.flatnonzero(table.column("bar_idx").to_numpy() == 0)
            values = table.column(x).to_numpy()
            for a, b in zip(starts, [*starts[1:], len(values)]):
                v = values[a:b]
                k = np.arange(1, (len(v) - 1) // 2 + 1)
                power = np.abs(np.fft.rfft(v - v.mean())[k]) ** 2
                told = [pa.repeat(table.column(name)[int(a)], len(k)) for name in keys]
                yield pa.RecordBatch.from_arrays([*told, pa.array(k), pa.array(k * sampling_rate / len(v)), pa.array(power)], names=[*keys, "k", "freq", "power"])

    return d.repartition(*keys).sortWithinPartitions(*keys, "bar_idx").mapInArrow(kernel, f"{named}, {_LINES}")


def _long_spectrum(df: DataFrame, x: str, keys: list[str], sampling_rate: float) -> DataFrame:
    lengths = stage(df.groupBy(*keys, F.col("n_bars").alias("m")).agg(F.avg(x).alias("_mean")))
    names = [*keys, "m"]
    samples = df.join(lengths, keys).select(*names, F.col("bar_idx").alias("t"), (F.col(x) - F.col("_mean")).alias("re"), F.lit(0.0).alias("im"))

    def power(told: dict, k: np.ndarray, line: np.ndarray) -> dict:
        inside = (k >= 1) & (k <= (told["m"] - 1) // 2)
        k = k[inside]
        return {"k": pa.array(k), "freq": pa.array(k * sampling_rate / told["m"]), "power": pa.array(np.abs(line[inside]) ** 2)}

    return dft(samples, lengths, names, power, _LINES).select(*keys, "k", "freq", "power")


def dominant_peaks(
    spectrum: DataFrame, n_peaks: int = 5, min_ratio: float = 0.01, keys: list[str] = SERIES
) -> DataFrame:
    """Strict interior local maxima holding at least ``min_ratio`` of the top power; best n."""
    top = spectrum.groupBy(*keys).agg(F.max("power").alias("_top"), F.max("k").alias("n_bars"))
    s = spectrum.join(top, keys).withColumn("bar_idx", F.col("k") - 1)
    w = chunk_window(keys)
    s = lay_out(s, back=1, ahead=1)
    s = drop_halo(s.withColumn("_l", F.lag("power").over(w)).withColumn("_r", F.lead("power").over(w)))
    peaks = s.where(
        (F.col("power") > F.col("_l"))
        & (F.col("power") > F.col("_r"))
        & (F.col("power") >= F.col("_top") * min_ratio)
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("power"), "k")
    return (
        peaks.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n_peaks)
        .select(*keys, "rank", "k", "freq", "power",
                F.when(F.col("freq") > 0, 1.0 / F.col("freq")).otherwise(F.lit(float("inf"))).alias("period"))
    )


#: Windows transformed at once.
_AT_ONCE = 1 << 20


def _chunks_with_halo(df: DataFrame, x: str, window: int, step: Column, keys: list[str]) -> DataFrame:
    """Bars in chunks of consecutive bars, each with the bars of the windows that start in it: one row per bar and chunk.

    A window is never longer than the series; its bars leave a chunk by less than its length.
    """
    d = df.select(*keys, "bar_idx", "n_bars", F.col(x).cast("double").alias("_x"))
    d = d.withColumns({"w_len": F.least(F.lit(window), F.col("n_bars")).cast("int"), "_step": step.cast("int")})
    size = max(series.CHUNK_BARS, 4 * window)
    first = F.greatest(F.lit(0), F.floor((F.col("bar_idx") - F.col("w_len") + 1) / size))
    return d.withColumn("_chunk", F.explode(F.sequence(first, F.floor(F.col("bar_idx") / size)))).withColumn("_from", F.col("_chunk") * size).withColumn("_to", F.col("_from") + size)


def density(windows: np.ndarray) -> np.ndarray:
    """One-sided Hann periodogram (unit sampling rate) of each row."""
    n = windows.shape[1]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    out = np.abs(np.fft.rfft((windows - windows.mean(1, keepdims=True)) * taper, axis=1)) ** 2 / np.sum(taper**2)
    out[:, 1 : (n + 1) // 2] *= 2
    return out


def _per_chunk(df: DataFrame, x: str, window: int, step: Column, keys: list[str], told, out: str) -> DataFrame:
    """The rows that ``told`` makes of the windows that start in each chunk.

    ``told`` gets an iterator of (window ids, starts, densities) and the windows' length. The windows are a strided
    view of the chunk's bars, transformed many at a time.
    """
    laid = _chunks_with_halo(df, x, window, step, keys)
    named = ", ".join(f"`{k}` {laid.schema[k].dataType.simpleString()}" for k in keys)

    def windows_of(values: np.ndarray, first: int, n_bars: int, length: int, step: int, begin: int, end: int):
        starts = np.arange(-(-begin // step) * step, min(end, n_bars - length + 1), step)
        if len(starts):
            view = np.lib.stride_tricks.sliding_window_view(values, length)
            for a in range(0, len(starts), max(1, _AT_ONCE // length)):
                some = starts[a : a + max(1, _AT_ONCE // length)]
                yield some // step, some, density(view[some - first])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_chunks(batches, [*keys, "_chunk"]):
            at = table.column("bar_idx").to_numpy()
            values = table.column("_x").to_numpy()
            one = {name: int(table.column(name)[0].as_py()) for name in ("n_bars", "w_len", "_step", "_from", "_to")}
            windows = windows_of(values, int(at[0]), one["n_bars"], one["w_len"], one["_step"], one["_from"], one["_to"])
            for columns in told(windows, one["w_len"]):
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*[pa.repeat(table.column(k)[0], n) for k in keys], *columns], names=[*keys, *names])

    names = [f.name for f in T._parse_datatype_string(out).fields]
    return laid.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "bar_idx").mapInArrow(kernel, f"{named}, {out}")


def window_spectra(
    df: DataFrame, x: str, window: int, step: Column, keys: list[str] = SERIES, sampling_rate: float = 1.0
) -> DataFrame:
    """(series, window_id, k, freq, psd) for every sliding window."""
    def told(windows, length):
        for ids, starts, psd in windows:
            n, lines = psd.shape
            k = np.tile(np.arange(lines), n)
            yield [pa.array(np.repeat(ids, lines)), pa.array(np.full(n * lines, length)), pa.array(np.repeat(starts, lines)),
                   pa.array(k), pa.array(k * sampling_rate / length), pa.array(psd.ravel() / sampling_rate)]

    return _per_chunk(df, x, window, step, keys, told, "window_id long, w_len long, start_idx long, k long, freq double, psd double")


def welch_psd(
    df: DataFrame, x: str = "close", window: int = 256, overlap: float = 0.5, keys: list[str] = SERIES,
    sampling_rate: float = 1.0,
) -> DataFrame:
    """Mean of the window periodograms; segments overlap by int(window * overlap) bars."""
    length = F.least(F.lit(window), F.col("n_bars"))
    step = length - (length * overlap).cast("long")

    def told(windows, length):
        """A chunk's windows summed up by k."""
        k, n = np.arange(length // 2 + 1), 0
        total = np.zeros(len(k))
        for _, _, psd in windows:
            total, n = total + psd.sum(0), n + len(psd)
        if n:
            yield [pa.array(k), pa.array(k * sampling_rate / length), pa.array(total / sampling_rate), pa.array(np.full(len(k), n))]

    parts = _per_chunk(df, x, window, step, keys, told, "k long, freq double, total double, n long")
    return parts.groupBy(*keys, "k", "freq").agg((F.sum("total") / F.sum("n")).alias("psd"))


def _slide_step(window: int, overlap: float) -> Column:
    length = F.least(F.lit(window), F.col("n_bars"))
    return F.greatest(F.lit(1), (length * (1 - overlap)).cast("long"))


def sliding_dominant_period(
    df: DataFrame, x: str = "close", window: int = 256, overlap: float = 0.5, keys: list[str] = SERIES,
    sampling_rate: float = 1.0,
) -> DataFrame:
    """Period of the strongest non-zero frequency of every window (lowest frequency on ties)."""
    def told(windows, length):
        for ids, starts, psd in windows:
            if psd.shape[1] > 1:
                # the first of equal maxima
                k = psd[:, 1:].argmax(1) + 1
                yield [pa.array(ids), pa.array(starts + length // 2), pa.array(1.0 / (k * sampling_rate / length))]

    return _per_chunk(df, x, window, _slide_step(window, overlap), keys, told, "window_id long, center_idx long, period double")


def spectrogram(
    df: DataFrame, x: str = "close", window: int = 256, overlap: float = 0.5, max_period: float = 100,
    keys: list[str] = SERIES,
) -> DataFrame:
    """log10 power per (window centre, period), for periods up to ``max_period`` bars."""
    spectra = window_spectra(df, x, window, _slide_step(window, overlap), keys)
    period = F.try_divide(F.lit(1.0), F.col("freq"))
    return spectra.where(F.col("k") > 0).where(period <= max_period).select(
        *keys, "window_id", (F.col("start_idx") + F.floor(F.col("w_len") / 2)).alias("center_idx"),
        "k", period.alias("period"), F.log10(F.col("psd") + 1e-10).alias("log_psd"),
    )
