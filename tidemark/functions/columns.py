"""Column builders: everything here stays inside Catalyst expressions.

Builders that look at neighbouring bars take the window to use (see ``operators.series``); missing
neighbours are NULL and every condition is coalesced to false, so no NaN ever decides a signal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec, functions as F

from tidemark.schema import INTERVALS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def each(first, last) -> Column:
    """One row per whole number in [first, last]."""
    ends = [(F.lit(v) if not isinstance(v, Column) else v).cast("long") for v in (first, last)]
    return F.explode(F.sequence(*ends))


# --- periods and cut-offs -----------------------------------------------------------------------

def cutoff_fraction(min_period, total, scale=1.0) -> Column:
    """Low-pass cut-off as a fraction of Nyquist; a non-positive period means no filtering."""
    period, n, s = (F.lit(v) if not isinstance(v, Column) else v for v in (min_period, total, scale))
    wanted = (n / period) * s
    return F.when(period <= 0, 1.0).otherwise(F.least(wanted / (n / 2.0), F.lit(1.0)))


def hours_per_bar(interval: str | Column) -> Column:
    """Unknown interval names count as one hour."""
    pairs = [F.lit(v) for name, (_, hours) in INTERVALS.items() if name != "1d" for v in (name, hours)]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(interval)), F.lit(1.0))


def hours_to_bars(hours: str | Column, interval: str | Column, at_least_one: bool = True) -> Column:
    bars = (col(hours) / hours_per_bar(interval)).cast("int")
    return F.greatest(F.lit(1), bars) if at_least_one else bars


def period_label(bars: str | Column, interval: str | Column) -> Column:
    """e.g. ``24.5 bars (24.5h)``, in days from 24 hours on; ties round to even."""
    hours = col(bars) * hours_per_bar(interval)
    shown = [F.bround(c.cast("double"), 1) for c in (col(bars), hours, hours / 24)]
    return F.when(hours < 24, F.format_string("%.1f bars (%.1fh)", shown[0], shown[1])).otherwise(
        F.format_string("%.1f bars (%.1fd)", shown[0], shown[2])
    )


# --- volatility and stop bands ------------------------------------------------------------------

def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    spread = F.col("high") - F.col("low")
    return F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def stop_bands(centre: str | Column, width: str | Column, k_stop, k_profit) -> dict[str, Column]:
    """Four bands around a centre line, ``k`` widths away."""
    mid, w = col(centre), col(width)
    return {
        "long_stop": mid - k_stop * w,
        "long_profit": mid + k_profit * w,
        "short_stop": mid + k_stop * w,
        "short_profit": mid - k_profit * w,
    }


def residual_sigma(x, smoothed, w: WindowSpec) -> Column:
    return F.coalesce(F.stddev_samp(col(x) - col(smoothed)).over(w), F.lit(0.0))


def residual_quantile(x, smoothed, w: WindowSpec, q: float = 0.95) -> Column:
    return F.coalesce(F.percentile(F.abs(col(x) - col(smoothed)), F.lit(q)).over(w), F.lit(0.0))


# --- signals ------------------------------------------------------------------------------------

def slope(x, lookback: int, w: WindowSpec) -> Column:
    return col(x) - F.lag(col(x), lookback).over(w)


def slope_by(x, lookback: Column, choices: list[int], w: WindowSpec) -> Column:
    """Slope with a per-row look-back taken from a known set of values."""
    return F.coalesce(*[F.when(lookback == k, slope(x, k, w)) for k in sorted(set(choices))])


def crosses_above(x, ref, w: WindowSpec) -> Column:
    return holds((F.lag(col(x)).over(w) <= F.lag(col(ref)).over(w)) & (col(x) > col(ref)))


def crosses_below(x, ref, w: WindowSpec) -> Column:
    return holds((F.lag(col(x)).over(w) >= F.lag(col(ref)).over(w)) & (col(x) < col(ref)))


def trend_entry(
    x, smoothed, w: WindowSpec, slope_col: Column, threshold=0.0, min_volatility: float = 0.0, volatility=None
) -> Column:
    rising = crosses_above(x, smoothed, w) & holds(slope_col > threshold)
    if min_volatility > 0 and volatility is not None:
        rising = rising & holds(col(volatility) >= min_volatility)
    return rising


def signal_code(entry: Column, leave: Column) -> Column:
    """-1 wins over 1 on the same bar."""
    return F.when(holds(leave), -1).when(holds(entry), 1).otherwise(0)


def trend_direction(x, smoothed, lookback: int, w: WindowSpec) -> Column:
    s = F.coalesce(slope(smoothed, lookback, w), F.lit(0.0))
    up, down = col(x) > col(smoothed), col(x) < col(smoothed)
    return F.when(up & (s > 0), 1).when(down & (s < 0), -1).otherwise(0)


def timeframes_agree(trends: list[str | Column], direction: int, require_all: bool = True) -> Column:
    votes = reduce(lambda a, b: a + b, [(col(t) == direction).cast("int") for t in trends])
    return votes >= (len(trends) if require_all else 2)


def keep_aligned(signal, aligned: Column, direction: int = 1) -> Column:
    unaligned_entry = (col(signal) == (1 if direction == 1 else -1)) & ~holds(aligned)
    return F.when(unaligned_entry, 0).otherwise(col(signal))


def merge_directions(long_signal, short_signal) -> Column:
    """Short entries (2) and exits (-2) take the place of whatever the long pass said."""
    s = col(short_signal)
    return F.when(s == 1, 2).when(s == -1, -2).otherwise(col(long_signal))


def slope_reverses(smoothed, lookback: int, threshold: float, w: WindowSpec) -> Column:
    """Sign flip of the slope with both slopes beyond the threshold; early slopes count as zero.

    Needs ``back = lookback + 1``.
    """
    now = F.coalesce(slope(smoothed, lookback, w), F.lit(0.0))
    before = F.coalesce(
        F.lag(col(smoothed), 1).over(w) - F.lag(col(smoothed), lookback + 1).over(w), F.lit(0.0)
    )
    return (F.abs(before) > threshold) & (F.abs(now) > threshold) & (F.signum(before) * F.signum(now) < 0)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [holds(c) for c in conditions], F.lit(False))


def held_too_long(entry_idx, current_idx, max_bars: int) -> Column:
    return (col(entry_idx) >= 0) & (col(current_idx) - col(entry_idx) >= max_bars)


# --- position sizing ----------------------------------------------------------------------------

def volatility_size(
    capital, entry, stop, volatility, risk_target: float, max_risk: float, mode: str = "atr"
) -> Column:
    cash, price, vol = col(capital), col(entry), col(volatility)
    gap = F.abs(price - col(stop))
    risk = F.when(gap > 0, gap).otherwise(vol)
    wanted = F.try_divide(cash * risk_target, vol if mode == "sigma" else risk)
    size = F.least(wanted, F.try_divide(cash * max_risk, risk), F.try_divide(cash, price))
    return F.when((cash > 0) & (price > 0) & (vol > 0), F.greatest(size, F.lit(0.0))).otherwise(0.0)


def fixed_risk_size(capital, entry, stop, fraction: float) -> Column:
    cash, price = col(capital), col(entry)
    risk = F.abs(price - col(stop))
    size = F.least(F.try_divide(cash * fraction, risk), F.try_divide(cash, price))
    usable = (cash > 0) & (price > 0) & (risk > 0)
    return F.when(usable, F.greatest(size, F.lit(0.0))).otherwise(0.0)


def pyramid_size(initial, current, max_pyramids: int, scale: float = 0.5) -> Column:
    first, now = col(initial), col(current)
    added = (F.log(F.try_divide(now, first)) / F.log(F.lit(1.0 + scale))).cast("int") + 1
    return (
        F.when((first <= 0) | (now < first), 0.0)
        .when(added >= max_pyramids, 0.0)
        .otherwise(first * scale)
    )


def pyramid_allowed(entry, current, threshold: float, direction: int) -> Column:
    gain = F.try_divide(col(current) - col(entry), col(entry))
    reached = gain >= threshold if direction == 1 else gain <= -threshold
    return F.when(col(entry) <= 0, False).otherwise(reached)
