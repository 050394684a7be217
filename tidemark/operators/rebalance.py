"""The chain of accepted rebalances: a target is taken where some weight is off by more than a threshold.

What counts is the distance to the weights taken last, so one decision hangs on the one before. But from a given
check on, the next one taken is known without the chain: the first later check at which some member is off. The
largest distance exceeds the threshold where any member's does, so every member is looked at on its own and the
earliest of their answers counts. The pointers to the next check are then followed by ``chains.taken_in_turn``.
Where the members change a target is always taken, so a chain starts anew there.

A member's checks are worked on in chunks. Within a chunk the first value outside a band is found by doubling over
range maxima and minima. From where a chunk holds none, the later chunks' largest and smallest weights tell
which is the first to hold one, and only that one is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import series
from tidemark.operators.chains import taken_in_turn
from tidemark.operators.series import chunk_window, drop_halo, home_chunk, lay_out, running, with_ordinal
from tidemark.operators.smooth import whole_chunks
from tidemark.plans.staging import stage

PK = ["portfolio"]
#: Checks are numbered within ranges of this many bars.
RANGE = 2**17


def first_outside(values: np.ndarray, of: np.ndarray, start: np.ndarray, threshold: float) -> np.ndarray:
    """For each of ``of`` the first place in ``values`` from ``start`` on that is off by more than ``threshold``;
    the number of values where none is."""
    high, low = [values], [values]
    while 2 ** len(high) <= len(values):
        half = 2 ** (len(high) - 1)
        high.append(np.maximum(high[-1][:-half], high[-1][half:]))
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    at = start.astype(np.int64)
    for level in reversed(range(len(high))):
        whole = at + 2**level <= len(values)
        i = np.where(whole, at, 0)
        at = at + 2**level * (whole & (high[level][i] - of <= threshold) & (of - low[level][i] <= threshold))
    return at


def _walked(targets: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, check) of the accepted checks of portfolios with few of them: walked in order, one row a check."""
    one = F.array_sort(F.collect_list(F.struct("symbol", "weight")))
    rows = targets.groupBy(*keys, "check").agg(one.alias("_w")).select(
        *keys, "check", F.col("_w.symbol").alias("symbols"), F.col("_w.weight").alias("weights")
    )
    given = rows.select(*keys, "check").schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, members, held = None, None, None
        for pdf in batches:
            keep = []
            for key, names, target in zip(zip(*[pdf[k] for k in keys]), pdf["symbols"], pdf["weights"]):
                # weights compare only between the same members
                fresh = key != current or list(names) != members
                taken = fresh or np.abs(np.asarray(target) - held).max() > threshold
                if taken:
                    current, members, held = key, list(names), np.asarray(target)
                keep.append(taken)
            yield pdf.loc[pd.Series(keep, index=pdf.index, dtype=bool), [*keys, "check"]]

    return rows.repartition(*keys).sortWithinPartitions(*keys, "check").mapInPandas(walk, given)


def _numbered(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check, bar_idx, _set): checks numbered from 0, and the number of changes of the members so far."""
    name = F.xxhash64("symbol", F.lit(1)).cast("decimal(38,0)")
    checks = targets.groupBy(*keys, "check").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(name).alias("_sum"), F.bit_xor(F.xxhash64("symbol", F.lit(2))).alias("_xor"))
    checks = checks.select(*keys, "check", F.struct("_n", "_sum", "_xor").alias("_members"))
    d = lay_out(with_ordinal(checks, keys, "check", F.floor(F.col("check") / RANGE)), back=1)
    before = F.lag("_members").over(chunk_window(keys))
    d = drop_halo(d.withColumn("_new", F.when(before.isNull() | (before != F.col("_members")), 1).otherwise(0)))
    return running(d, {"_set": ("sum", F.col("_new"))}, keys).select(*keys, "check", "bar_idx", F.col("_set").cast("long").alias("_set"))


def _within_chunks(values: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, _set, bar_idx, free): the next check that some member asks for in the same chunk, if any."""
    cell = [*keys, "_set", "symbol", "_chunk"]
    named = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in [*keys, "_set"])

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_chunks(batches, cell):
            idx, weight = table["bar_idx"].to_numpy(), table["weight"].to_numpy()
            at = first_outside(weight, weight, np.arange(1, len(idx) + 1), threshold)
            free = pa.array(np.append(idx, 0)[at], mask=at == len(idx))
            columns = [table[k].combine_chunks() for k in [*keys, "_set", "bar_idx"]]
            yield pa.RecordBatch.from_arrays([*columns, free], names=[*keys, "_set", "bar_idx", "free"])

    rows = values.select(*cell, "bar_idx", "weight").repartition(*cell).sortWithinPartitions(*cell, "bar_idx")
    found = rows.mapInArrow(point, f"{named}, bar_idx long, free long")
    return found.groupBy(*keys, "_set", "bar_idx").agg(F.min("free").alias("free"))


def _beyond_chunks(values: DataFrame, open_checks: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, _set, bar_idx, free) of checks from which no member asks for another one in the same chunk.

    Chunks tell their range of weights, one row a member and chunk. A chunk's open checks meet the values of the chunk
    they go on in, so a task holds two chunks of one member.
    """
    member = [*keys, "_set", "symbol"]
    waiting = values.join(open_checks, [*keys, "_set", "bar_idx"])
    ranges = values.groupBy(*member, "_chunk").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    ranges = ranges.groupBy(*member).agg(F.array_sort(F.collect_list(F.struct("_chunk", "low", "high"))).alias("_ranges"))
    leaves = F.array_min(F.transform(F.filter("_ranges", lambda r: (r["_chunk"] > F.col("_chunk")) & (
        (r["high"] - F.col("weight") > threshold) | (F.col("weight") - r["low"] > threshold))), lambda r: r["_chunk"]))
    here = [*keys, "_set", "bar_idx"]
    goes = waiting.join(ranges, member).select(*member, "_chunk", "bar_idx", "weight", leaves.alias("_to"))
    # the earliest chunk that any member names holds the next check
    first = goes.groupBy(*here).agg(F.min("_to").alias("_first"))
    goes = stage(goes.join(first, here).where(F.col("_to") == F.col("_first")).drop("_first"))
    trip = [*member, "_chunk", "_to"]
    met = values.withColumnRenamed("_chunk", "_to").join(goes.select(*trip).distinct(), [*member, "_to"]).select(
        *trip, "bar_idx", "weight")
    met = met.toDF(*met.columns)  # fresh column identities: both sides of the cogroup come from the same frame
    named = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in [*keys, "_set"])

    def find(waits: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by("bar_idx")
        at = first_outside(there["weight"].to_numpy(), waits["weight"].to_numpy(), np.zeros(waits.num_rows), threshold)
        return waits.select(here).append_column("free", pa.array(there["bar_idx"].to_numpy()[at]))

    found = goes.groupBy(*trip).cogroup(met.groupBy(*trip)).applyInArrow(find, f"{named}, bar_idx long, free long")
    return found.groupBy(*here).agg(F.min("free").alias("free"))


def _pointed(targets: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, check) of the accepted checks by pointers to the next one, chunk by chunk."""
    numbered = stage(_numbered(targets, keys))
    values = targets.join(numbered, [*keys, "check"]).select(
        *keys, "_set", "symbol", "bar_idx", F.col("weight").cast("double").alias("weight"), home_chunk().cast("long").alias("_chunk"))
    values = stage(values)
    near = stage(_within_chunks(values, threshold, keys))
    here = [*keys, "_set", "bar_idx"]
    far = _beyond_chunks(values, near.where("free IS NULL").select(*here), threshold, keys)
    # a check without a later one keeps its weights for good
    free = near.join(far.withColumnRenamed("free", "_far"), here, "left").select(*here, F.coalesce("free", "_far").alias("free"))
    taken = taken_in_turn(stage(free), [*keys, "_set"])
    return numbered.join(taken, here, "left_semi").select(*keys, "check")


def accept_targets(targets: DataFrame, threshold: float = 0.05, keys: list[str] = PK) -> DataFrame:
    """(keys, check, symbol, weight) of the checks whose target is taken: the first of a portfolio, one whose members
    are not those taken last, or one where some weight is off from the last taken by more than ``threshold``.

    A missing weight (null or NaN) is no member. Portfolios of up to a chunk of checks are walked, each in one
    task; if one has more, all go by pointers. Both give the same rows.
    """
    known = targets.where(F.col("weight").isNotNull() & ~F.isnan("weight")).select(*keys, "check", "symbol", "weight")
    known = stage(known)
    longest = known.groupBy(*keys).agg(F.count_distinct("check").alias("n")).agg(F.max("n")).first()[0] or 0
    solve = _walked if longest <= series.CHUNK_BARS else _pointed
    return known.join(solve(known, threshold, keys), [*keys, "check"], "left_semi")
