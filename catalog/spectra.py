"""Spectra (F4-F8)."""

from __future__ import annotations

from catalog.base import HOURLY, indexed, query, r, rounded, rs, with_
from tidemark.operators import spectral as sp

FFT = f"""{HOURLY}, fk AS (SELECT symbol, n_bars AS n, unnest(range(1, (n_bars - 1) // 2 + 1)) AS k FROM ib WHERE bar_idx = 0),
  av AS (SELECT symbol, avg(close) AS m FROM ib GROUP BY symbol),
  fft AS (SELECT symbol, k, k::DOUBLE / n AS freq, power(sum((close - m) * cos(2 * pi() * k * bar_idx / n)), 2)
    + power(sum((close - m) * sin(2 * pi() * k * bar_idx / n)), 2) AS power FROM fk JOIN ib USING (symbol) JOIN av USING (symbol) GROUP BY symbol, k, n)"""


@query("f4_fft_spectrum", with_(FFT, f"SELECT symbol, k, {rs('freq power')} FROM fft"))
def f4(spark, sf):
    return rounded(sp.fft_spectrum(indexed(spark, sf)).select("symbol", "k", "freq", "power"))


@query("f5_dominant_peaks", with_(FFT, f"""SELECT symbol, rank, k, {rs('freq power')}, {r('1 / freq', 'period')} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY power DESC, k) AS rank FROM (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS n,
  max(power) OVER (PARTITION BY symbol) AS top FROM fft WINDOW w AS (PARTITION BY symbol ORDER BY k))
  WHERE power > l AND power > n AND power >= 0.01 * top) WHERE rank <= 5"""))
def f5(spark, sf):
    peaks = sp.dominant_peaks(sp.fft_spectrum(indexed(spark, sf)))
    return rounded(peaks.drop("interval"))


def welch_sql(w: int, step: int) -> str:
    """Every window of w bars starting each ``step`` bars, as an explicit Hann-weighted DFT."""
    return f"""ws AS (SELECT symbol, unnest(range(0, n_bars - {w} + 1, {step})) AS s FROM ib WHERE bar_idx = 0),
  wx AS (SELECT ws.symbol, ws.s, b.bar_idx - ws.s AS j, b.close - avg(b.close) OVER (PARTITION BY ws.symbol, ws.s) AS v
    FROM ws JOIN ib b ON b.symbol = ws.symbol AND b.bar_idx >= ws.s AND b.bar_idx < ws.s + {w}),
  wv AS (SELECT symbol, s, j, v * (0.5 - 0.5 * cos(2 * pi() * j / {w})) AS v FROM wx),
  hs AS (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / {w}), 2)) AS h FROM range({w}) t(j)),
  wk AS (SELECT unnest(range(0, {w} // 2 + 1)) AS k),
  psd AS (SELECT symbol, s, k, k::DOUBLE / {w} AS freq, (CASE WHEN k = 0 OR 2 * k = {w} THEN 1 ELSE 2 END) / any_value(h)
    * (power(sum(v * cos(2 * pi() * k * j / {w})), 2) + power(sum(v * sin(2 * pi() * k * j / {w})), 2)) AS psd
    FROM wv CROSS JOIN wk CROSS JOIN hs GROUP BY symbol, s, k)"""


W64 = f"{HOURLY}, {welch_sql(64, 32)}"


@query("f6_welch_psd", with_(W64, f"SELECT symbol, k, {r('freq', 'freq', 6)}, {r('avg(psd)', 'psd', 6)} FROM psd GROUP BY symbol, k, freq"))
def f6(spark, sf):
    return rounded(sp.welch_psd(indexed(spark, sf), window=64).select("symbol", "k", "freq", "psd"), 6)


W48 = f"{HOURLY}, {welch_sql(48, 12)}"


@query("f7_sliding_dominant_period", with_(W48, f"""SELECT symbol, s // 12 AS window_id, s + 24 AS center_idx, {r('1 / arg_max(freq, (psd, -k))', 'period')}
  FROM psd WHERE k > 0 GROUP BY symbol, s"""))
def f7(spark, sf):
    return rounded(sp.sliding_dominant_period(indexed(spark, sf), window=48, overlap=0.75).drop("interval"))


@query("f8_spectrogram", with_(W64, f"""SELECT symbol, s // 32 AS window_id, s + 32 AS center_idx, k, {r('1 / freq', 'period', 5)},
  {r('log10(psd + 1e-10)', 'log_psd', 5)} FROM psd WHERE k > 0 AND 1 / freq <= 20"""))
def f8(spark, sf):
    out = sp.spectrogram(indexed(spark, sf), window=64, max_period=20).drop("interval")
    return rounded(out, 5)
