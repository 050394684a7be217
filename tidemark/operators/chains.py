"""Chains along a series: of many candidates, those taken in turn.

A candidate at bar i keeps its series busy until bar ``free``; the next one taken is the first at or after that bar.
Chunks of candidates are solved on their own: pointers to the next free candidate, doubled until they leave the
chunk, tell for every place where a chain may enter the chunk where it goes on. Chains that begin apart soon run
together, so few different answers are left; only those are walked per series, and the chunks then tell which of
their candidates the chain met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.series import home_chunk
from tidemark.operators.smooth import whole_chunks
from tidemark.schema import SERIES

_NEVER = 2**62


def _pointers(idx: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The next candidate of each within its chunk; their number where there is none."""
    return np.searchsorted(idx, free)


def taken_in_turn(candidates: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """(keys, bar_idx) of the candidates that are taken: the first of a series, then always the first one at or
    after the last one's ``free``.

    ``candidates`` has keys, bar_idx (distinct in a series) and free, later than bar_idx or null for never.
    """
    free = F.coalesce(F.col("free").cast("long"), F.lit(_NEVER))
    nodes = candidates.select(*keys, F.col("bar_idx").cast("long").alias("bar_idx"), free.alias("free"), home_chunk().cast("long").alias("_chunk"))
    named = ", ".join(f"`{k}` {nodes.schema[k].dataType.simpleString()}" for k in keys)
    cell = [*keys, "_chunk"]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk: a chain that enters after the ``upto`` before and up to this one goes on at ``out``."""
        for table in whole_chunks(batches, cell):
            idx, free = table["bar_idx"].to_numpy(), table["free"].to_numpy()
            after = np.append(_pointers(idx, free), len(idx))
            out = np.append(free, 0)
            while (after[:-1] < len(idx)).any():
                inside = after < len(idx)
                out = np.where(inside, out[after], out)
                after = np.where(inside, after[after], after)
            out = out[:-1]
            last = np.append(out[1:] != out[:-1], True)
            yield pa.RecordBatch.from_arrays(
                [*[pa.repeat(table[k][0], int(last.sum())) for k in cell], pa.array(idx[last]), pa.array(out[last])], names=[*cell, "upto", "out"])

    pieces = nodes.repartition(*cell).sortWithinPartitions(*cell, "bar_idx").mapInArrow(leave, f"{named}, _chunk long, upto long, out long")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            upto, out = batch.column("upto").to_numpy(), batch.column("out").to_numpy()
            # a series begins where a key changes
            names = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            met, entered = [], []
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                if names[a] != current:
                    current, at = names[a], 0
                i = a + int(np.searchsorted(upto[a:b], at))
                while i < b:
                    met.append(i)
                    entered.append(at)
                    at = int(out[i])
                    i = a + int(np.searchsorted(upto[a:b], at))
            if met:
                some = batch.take(pa.array(met))
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in cell], pa.array(entered, pa.int64())], names=[*cell, "entered"])

    visits = pieces.repartition(*keys).sortWithinPartitions(*keys, "upto").mapInArrow(walk, f"{named}, _chunk long, entered long")

    def keep(chunk: pa.Table, visit: pa.Table) -> pa.Table:
        if not visit.num_rows or not chunk.num_rows:
            return chunk.select([*keys, "bar_idx"]).slice(0, 0)
        chunk = chunk.sort_by("bar_idx")
        idx = chunk["bar_idx"].to_numpy()
        after, met = _pointers(idx, chunk["free"].to_numpy()), []
        i = int(np.searchsorted(idx, visit["entered"][0].as_py()))
        while i < len(idx):
            met.append(i)
            i = int(after[i])
        return chunk.select([*keys, "bar_idx"]).take(pa.array(met, pa.int64()))

    return nodes.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(keep, f"{named}, bar_idx long")
