"""Ordered work over series that may be far longer than one task should hold.

A bar frame is first given a dense ``bar_idx`` per series (``with_ordinal``), and is then worked on
in chunks of consecutive bars.  Three shapes cover the ordered operators:

* bounded look-back / look-ahead: ``lay_out`` copies the few boundary rows a neighbour chunk needs
  (the halo), after which plain Spark windows over ``(keys, chunk)`` are exact;
* running aggregates: ``running`` combines a window inside the chunk with a carry taken from
  one-row-per-chunk totals;
* exponential decay: ``ewm_mean`` does the same with decaying weights.

So no sort or window ever sees more than one chunk of bars; windows over a whole series run only on
chunk totals, i.e. a few thousand times fewer rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.schema import SERIES

CHUNK_BARS = 4096  # bars per chunk; read at call time, so it can be changed for a session
EWM_BLOCK = 256
_ALL_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO_NOW = (Window.unboundedPreceding, 0)


def day_bucket(order: str, days: int = 28) -> Column:
    """A coarse, order-preserving bucket of a timestamp (plain arithmetic on its microseconds)."""
    return F.expr(f"(`{order}` - TIMESTAMP_NTZ'1970-01-01 00:00:00') div INTERVAL '{days}' DAY")


def with_ordinal(
    df: DataFrame,
    keys: list[str] = SERIES,
    order: str = "open_time",
    bucket: Column | None = None,
    name: str = "bar_idx",
) -> DataFrame:
    """Dense 0-based position in the series, plus the series length as ``n_bars``.

    Rows are ranked inside time buckets; the bucket offset is a running sum over bucket counts.
    """
    d = df.withColumn("_bucket", bucket if bucket is not None else day_bucket(order))
    cells = [*keys, "_bucket"]
    per_series = Window.partitionBy(*keys)
    offsets = d.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).select(
        *cells,
        F.coalesce(
            F.sum("_n").over(per_series.orderBy("_bucket").rowsBetween(*_ALL_BEFORE)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(per_series).alias("n_bars"),
    )
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy(order))
    return (
        d.withColumn("_rank", rank)
        .join(offsets, cells)
        .withColumn(name, (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_bucket", "_rank", "_offset")
    )


def home_chunk(idx: str | Column = "bar_idx") -> Column:
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / CHUNK_BARS)


def chunks_between(start: str | Column, end: str | Column) -> Column:
    """The chunks touched by the half-open index range [start, end)."""
    last = (F.col(end) if isinstance(end, str) else end) - 1
    return F.sequence(home_chunk(start), home_chunk(last))


def lay_out(df: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """Assign rows to chunks; boundary rows also go to the chunks that look back/ahead at them."""
    home = home_chunk()
    first = home_chunk(F.greatest(F.col("bar_idx") - ahead, F.lit(0)))
    last = home_chunk(F.least(F.col("bar_idx") + back, F.col("n_bars") - 1))
    if back == 0 and ahead == 0:
        return df.withColumn("chunk", home).withColumn("halo", F.lit(False))
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "halo", F.col("chunk") != home
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("halo")).drop("halo")


def chunk_window(keys: list[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy("bar_idx")


def trailing(keys: list[str], rows: int) -> WindowSpec:
    """The last ``rows`` bars including the current one (needs ``back >= rows - 1``)."""
    return chunk_window(keys).rowsBetween(-(rows - 1), 0)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0.0)) + F.coalesce(local, F.lit(0.0))
    if kind == "product":
        return F.coalesce(carry, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "first":
        return F.coalesce(carry, local)
    raise ValueError(f"unknown running aggregate {kind!r}")


_WINDOWED = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    keys: list[str] = SERIES,
    order: str = "bar_idx",
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates ``{name: (kind, expression)}`` along each series, with or without the row itself.

    Kinds: sum, product, max, min, last (non-null), first (non-null).  The frame must not contain
    halo rows; a ``chunk`` column is used if present (with ``order="bar_idx"`` it must be the home
    chunk, and ``n_bars``, if present, the series length).
    """
    home = order == "bar_idx"
    d = df if "chunk" in df.columns else df.withColumn("chunk", home_chunk())
    cells = [*keys, "chunk"]
    d = d.withColumns({f"_v_{name}": expr for name, (_, expr) in specs.items()})

    def total(name: str, kind: str) -> Column:
        value = F.col(f"_v_{name}")
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        if kind == "first":
            return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
        return _WINDOWED[kind](value)

    # only chunks with a successor hand something on
    giving = d.where(F.col("chunk") < home_chunk(F.col("n_bars") - 1)) if home and "n_bars" in d.columns else d
    totals = giving.groupBy(*cells).agg(*[total(n, k).alias(f"_t_{n}") for n, (k, _) in specs.items()])
    so_far = Window.partitionBy(*keys).orderBy("chunk")
    handed = totals.select(
        *cells,
        F.lead("chunk").over(so_far).alias("_next"),
        *[
            _WINDOWED[k](F.col(f"_t_{n}")).over(so_far.rowsBetween(*_UP_TO_NOW)).alias(f"_c_{n}")
            for n, (k, _) in specs.items()
        ],
    )
    # chunks are consecutive along bar_idx; other chunkings may skip numbers
    following = F.col("chunk") + 1 if home else F.col("_next")
    carry = handed.select(*keys, following.alias("chunk"), *[f"_c_{n}" for n in specs])
    here = Window.partitionBy(*cells).orderBy(order).rowsBetween(*(_UP_TO_NOW if inclusive else _ALL_BEFORE))
    d = d.withColumns({f"_l_{n}": _WINDOWED[k](F.col(f"_v_{n}")).over(here) for n, (k, _) in specs.items()})
    out = d.join(carry, cells, "left").withColumns(
        {n: _combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in specs.items()}
    )
    return out.drop(*[f"_{p}_{n}" for p in "vlc" for n in specs])


def ewm_mean(
    df: DataFrame,
    x: str,
    span: int | Column,
    name: str,
    keys: list[str] = SERIES,
    max_span: int | None = None,
) -> DataFrame:
    """Recursive exponential mean: y0 = x0, y = a*x + (1-a)*y_prev with a = 2/(span+1).

    Inside blocks of 256 bars the decay is undone by scaling. A block turns the state it is entered with into
    decay * state + end; these maps are composed by doubling, going back until the weight is below double precision
    (all the way if ``span`` is a column and no ``max_span`` is given).
    """
    limit = span if isinstance(span, int) else max_span
    span_col = F.lit(span) if isinstance(span, int) else span
    cells = [*keys, *(["chunk"] if "chunk" in df.columns else []), "_block"]
    d = (
        df.withColumn("_block", F.floor(F.col("bar_idx") / EWM_BLOCK))
        .withColumn("_p", F.pmod(F.col("bar_idx"), F.lit(EWM_BLOCK)))
        .withColumn("_r", 1.0 - 2.0 / (span_col + 1.0))
    )
    weight = F.when(F.col("bar_idx") == 0, 1.0).otherwise(1.0 - F.col("_r"))
    d = d.withColumn("_wx", weight * F.col(x))
    # a span of one has no memory at all: 0**-p must not be evaluated
    decay = F.when(F.col("_r") > 0, F.col("_r"))
    ends = d.groupBy(*cells).agg(
        F.sum(F.col("_wx") * F.pow(decay, EWM_BLOCK - 1 - F.col("_p"))).alias("_end"),
        F.first(decay).alias("_decay"),
    )
    if limit is not None:
        keep = max(limit - 1, 1) / (limit + 1)
        depth = max(1, math.ceil(41.5 / (EWM_BLOCK * -math.log(keep))))
    else:
        depth = (df.agg(F.max("bar_idx")).first()[0] or 0) // EWM_BLOCK + 1
    along = Window.partitionBy(*keys).orderBy("_block")
    maps = ends.select(*cells, F.coalesce(F.pow("_decay", F.lit(EWM_BLOCK)), F.lit(0.0)).alias("_a"), F.coalesce("_end", F.lit(0.0)).alias("_b"))
    for k in range((depth - 1).bit_length()):
        before = F.lag(F.struct("_a", "_b"), 2**k).over(along)
        maps = maps.withColumn("_before", before).select(
            *cells, F.coalesce(F.col("_a") * F.col("_before._a"), F.lit(0.0)).alias("_a"),
            (F.col("_b") + F.col("_a") * F.coalesce("_before._b", F.lit(0.0))).alias("_b"))
    carry = maps.select(*cells, F.lag("_b").over(along).alias("_in"))
    here = Window.partitionBy(*cells).orderBy("bar_idx").rowsBetween(*_UP_TO_NOW)
    local = F.pow(decay, F.col("_p")) * F.sum(F.col("_wx") * F.pow(decay, -F.col("_p"))).over(here)
    value = F.col("_local") + F.pow(decay, F.col("_p") + 1) * F.coalesce(F.col("_in"), F.lit(0.0))
    return (
        d.withColumn("_local", local)
        .join(carry, cells)
        .withColumn(name, F.coalesce(value, F.col(x)))
        .drop("_block", "_p", "_r", "_wx", "_local", "_in")
    )
