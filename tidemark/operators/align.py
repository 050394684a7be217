"""Joins and alignment of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.series import chunks_between, day_bucket, home_chunk, running
from tidemark.plans.staging import stage
from tidemark.schema import SERIES


def asof_join(
    lower: DataFrame, higher: DataFrame, suffix: str, keys: list[str] | None = None, time: str = "open_time"
) -> DataFrame:
    """Each lower row with the latest higher row at or before it; earlier rows take the first one.

    Union of both sides and a running last value over (key, four weeks), with a carry of one row per
    bucket: two passes over the union, and no key in one task.  Higher columns other than keys and time get ``_<suffix>``.
    """
    keys = keys or ["symbol"]
    payload = [c for c in higher.columns if c not in (*keys, time)]
    hi = F.struct(*[F.col(c).alias(f"{c}_{suffix}") for c in payload])
    own = [c for c in lower.columns if c not in (*keys, time)]
    both = lower.select(*keys, time, F.lit(1).alias("_side"), F.struct(*own).alias("_low")).unionByName(
        higher.select(*keys, time, F.lit(0).alias("_side"), hi.alias("_high")), allowMissingColumns=True
    )
    both = both.withColumn("_at", F.struct(time, "_side")).withColumn("chunk", day_bucket(time))
    seen = running(both, {"_match": ("last", F.col("_high"))}, keys, order="_at").where(F.col("_side") == 1)
    first = higher.groupBy(*keys).agg(F.min_by(hi, time).alias("_first"))
    out = seen.join(first, keys, "left").withColumn("_match", F.coalesce("_match", "_first"))
    return out.select(*keys, time, "_low.*", "_match.*")


def join_on_time(left: DataFrame, right: DataFrame, time: str = "open_time") -> DataFrame:
    return left.join(right, time, "inner")


def align_series(
    df: DataFrame, method: str = "intersection", key: str = "symbol", time: str = "open_time"
) -> DataFrame:
    """Common time line of all series: ``intersection`` (times every series has), ``union`` (full
    grid, missing rows NULL) or ``position`` (n-th bar of each; series of unequal length are an error)."""
    if method == "position":
        longest, shortest = df.agg(F.max("n_bars")).scalar(), df.agg(F.min("n_bars")).scalar()
        unequal = F.raise_error(F.lit("series have unequal lengths: align them by time"))
        return df.where(F.when(longest == shortest, F.lit(True)).otherwise(unequal.cast("boolean")))
    if method == "intersection":
        everyone = df.agg(F.count_distinct(key)).scalar()
        full = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == everyone)
        return df.join(full.select(time), time, "left_semi")
    if method == "union":
        # keys are numbered, and every time is listed once for each number: the grid is no larger than the result
        numbered = stage(df.select(key).distinct().withColumn("_key", F.row_number().over(Window.orderBy(key)).cast("long")))
        n = numbered.agg(F.max("_key")).first()[0] or 0
        grid = df.select(time).distinct().withColumn("_key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))) if n else F.lit(0).cast("long"))
        return grid.join(numbered, "_key").drop("_key").join(df, [time, key], "left")
    raise ValueError(f"unknown alignment {method!r}")


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default: object) -> DataFrame:
    """Left lookup with a default; Spark broadcasts the table when its size allows."""
    return df.join(table.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def in_windows(
    bars: DataFrame, windows: DataFrame, start: str, end: str, keys: list[str] = SERIES
) -> DataFrame:
    """Bars x half-open index windows [start, end), as an equi-join on the chunks a window covers."""
    spans = windows.where(F.col(start) < F.col(end)).withColumn("_chunk", F.explode(chunks_between(start, end)))
    on = [*[k for k in keys if k in windows.columns], "_chunk"]
    inside = (F.col("bar_idx") >= F.col(start)) & (F.col("bar_idx") < F.col(end))
    return bars.withColumn("_chunk", home_chunk()).join(spans, on).where(inside).drop("_chunk")


def pairs(
    df: DataFrame, value: str, key: str = "symbol", time: str = "open_time", with_self: bool = False
) -> DataFrame:
    """Values of every pair of series at the same time: (time, sym_i, sym_j, x, y), sym_i < sym_j."""
    left = df.select(time, F.col(key).alias("sym_i"), F.col(value).alias("x"))
    right = df.select(time, F.col(key).alias("sym_j"), F.col(value).alias("y"))
    order: Column = F.col("sym_i") <= F.col("sym_j") if with_self else F.col("sym_i") < F.col("sym_j")
    return left.join(right, time).where(order)
