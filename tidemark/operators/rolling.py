"""Rolling and running quantities along a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.align import in_windows, pairs
from tidemark.operators.chains import taken_in_turn
from tidemark.operators.moments import correlation_of
from tidemark.operators.series import drop_halo, lay_out, running, trailing, with_ordinal
from tidemark.schema import SERIES


def trailing_stop(
    bars: DataFrame, entries: DataFrame, stop: str = "long_stop", keys: list[str] = SERIES
) -> DataFrame:
    """Stop level that only moves in favour of the position, from each entry to its ``end_idx``.

    ``entries``: keys, entry_idx, end_idx (exclusive), direction.  An entry past the end of its
    series yields no rows.
    """
    held = in_windows(bars.select(*keys, "bar_idx", stop), entries, "entry_idx", "end_idx", keys)
    long = F.col("direction") == 1
    d = running(
        held,
        {
            "_hi": ("max", F.when(long, F.col(stop))),
            "_lo": ("min", F.when(~long, F.col(stop))),
        },
        [*keys, "entry_idx"],
    )
    return d.withColumn("trailing", F.coalesce("_hi", "_lo")).select(*keys, "entry_idx", "bar_idx", "trailing")


def rolling_correlation(
    returns: DataFrame, window: int = 60, value: str = "ret", key: str = "symbol", time: str = "open_time"
) -> DataFrame:
    """Pearson correlation of every pair of series over the last ``window`` common rows."""
    both = with_ordinal(pairs(returns, value, key, time), ["sym_i", "sym_j"], time)
    frame = trailing(["sym_i", "sym_j"], window)
    laid = lay_out(both, back=window - 1)
    full = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).over(frame) >= window
    together = F.col("x").isNotNull() & F.col("y").isNotNull()
    laid = laid.withColumns({"x": F.when(together, F.col("x")), "y": F.when(together, F.col("y"))})
    rho = F.when(full, correlation_of("x", "y", frame))
    return drop_halo(laid.withColumn("corr", rho)).select("sym_i", "sym_j", time, "corr")


def space_entries(df: DataFrame, min_bars: int, keys: list[str] = SERIES) -> DataFrame:
    """Turn entries closer than ``min_bars`` to the last kept entry into 0; exits stay."""
    entries = df.where(F.col("signal") == 1).select(*keys, "bar_idx", (F.col("bar_idx") + max(min_bars, 1)).alias("free"))
    kept = taken_in_turn(entries, keys).withColumn("_kept", F.lit(True))
    out = df.join(kept, [*keys, "bar_idx"], "left")
    dropped = (F.col("signal") == 1) & F.col("_kept").isNull()
    return out.withColumn("spaced", F.when(dropped, 0).otherwise(F.col("signal"))).drop("_kept")
