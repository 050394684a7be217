"""Exact top-k search by inner product: a kNN join over Voronoi cells.

Queries and data are grouped by their nearest pivot (``vectors.Space``: there the larger inner product is the
shorter distance). From summaries of the cells, their counts, radii and the k + 1 rows nearest to each pivot,
every query group gets a distance within which all its queries have k rows. A data row goes to those groups
only that it can be so near to, by the triangle inequality over both pivots. Groups are then solved on their
own, in units of bounded numbers of queries and rows, and each query's lists are ranked together.

Nothing is approximate: bounds carry a margin for rounding, and scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import vectors as vc
from tidemark.plans.staging import stage

#: Pivots, and so query groups: a row is dealt to each of them at most; rows they are chosen from.
PIVOTS, PIVOT_SAMPLE = 16, 4096
#: Queries and rows of a unit that is solved at once, and scores held at once.
QUERY_BLOCK, DATA_BLOCK, SCORES = 1 << 15, 1 << 17, 1 << 22
_CHUNK = 1024


@dataclass
class _Groups:
    """Of the query groups of one dimension: their cells, and for each data cell the distances that are needed."""

    cells: np.ndarray
    within: np.ndarray
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    query_slices: np.ndarray
    data_slices: np.ndarray


def _plan(space: vc.Space, located: DataFrame, k: int, query_block: int, data_block: int) -> dict[int, _Groups]:
    """From the cells' summaries, at most k + 3 numbers of each: what every group needs."""
    data = located.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("apart").alias("lo"), F.max("apart").alias("hi")).collect()
    nearest = Window.partitionBy("dim", "cell").orderBy("apart", "row")
    first = located.select("dim", "cell", "apart", "row").withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k + 1)
    heads: dict[tuple[int, int], list[float]] = {}
    for r in first.select("dim", "cell", "apart").collect():
        heads.setdefault((r[0], r[1]), []).append(r[2])
    asked = located.where("query_cell is not null").groupBy("dim", "query_cell").agg(F.count("*").alias("n"), F.max("query_apart").alias("hi")).collect()
    plan = {}
    for dim in sorted({r["dim"] for r in asked}):
        groups = sorted((r for r in asked if r["dim"] == dim), key=lambda r: r["query_cell"])
        cells = np.array([g["query_cell"] for g in groups])
        radius = np.array([g["hi"] for g in groups])
        within = np.full(len(cells), np.inf)
        low, high, rows = {}, {}, np.zeros(len(cells))
        here = [r for r in data if r["dim"] == dim]
        if dim in space.pivots:
            pivots, base = space.pivots[dim], space.first[dim]
            between = vc.distances(pivots[cells - base], pivots)
            bounds = [radius[:, None] + between[:, [r["cell"] - base]] + np.array(sorted(heads[dim, r["cell"]])) for r in here]
            bounds = np.sort(np.concatenate(bounds, axis=1), axis=1)
            # one of the rows may be the query itself
            if bounds.shape[1] > k:
                within = bounds[:, k] + space.slack(dim)
        for r in here:
            gap = between[:, r["cell"] - base] if dim in space.pivots else np.zeros(len(cells))
            reach = radius + within + space.slack(dim) if dim in space.pivots else within
            low[r["cell"]], high[r["cell"]] = gap - reach, gap + reach
            rows += np.where((low[r["cell"]] <= r["hi"]) & (high[r["cell"]] >= r["lo"]), r["n"], 0)
        plan[dim] = _Groups(
            cells, within, low, high, np.array([-(-g["n"] // query_block) for g in groups]),
            np.maximum(1, -(-rows // data_block)).astype(np.int64))
    return plan


_UNIT = ["dim", "unit", "query_slice", "data_slice"]


def _locate(rows: DataFrame, is_query: Column, space: vc.Space) -> DataFrame:
    """Adds the cell of each row and its distance to the pivot, and of queries those of their stretched form."""
    asked = rows.withColumn("asked", F.coalesce(is_query, F.lit(False)))
    fields = asked.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["cell int, apart double, query_cell int, query_apart double"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in vc.by_dim(batch):
                values = vc.decode(part.column(part.schema.get_field_index("vec")), dim)
                cell, apart = space.nearest(space.lifted(values, dim), dim)
                query, query_apart = space.nearest(space.stretched(values, dim), dim)
                idle = ~part.column(part.schema.get_field_index("asked")).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32()), pa.array(apart), pa.array(query, pa.int32(), mask=idle), pa.array(query_apart, mask=idle)],
                    names=[*part.schema.names, "cell", "apart", "query_cell", "query_apart"])

    return stage(asked.mapInArrow(locate, schema))


def _deal(located: DataFrame, plan: dict[int, _Groups]) -> DataFrame:
    """Queries to all units of their group, data rows to a unit of every group that needs them."""
    id_type = located.schema["id"].dataType.simpleString()
    schema = f"dim int, unit int, query_slice int, data_slice int, is_data int, row bigint, id {id_type}, vec binary"

    def rows_of(part: pa.RecordBatch, at: np.ndarray, unit, query_slice, data_slice, is_data: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(at), 1 << 15):
            cut = slice(a, a + (1 << 15))
            taken = part.take(pa.array(at[cut]))
            column = lambda name: taken.column(taken.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays(
                [column("dim"), pa.array(unit[cut], pa.int32()), pa.array(query_slice[cut], pa.int32()), pa.array(data_slice[cut], pa.int32()),
                 pa.array(np.full(taken.num_rows, is_data), pa.int32()), column("row"), column("id"), column("vec")],
                names=[*_UNIT, "is_data", "row", "id", "vec"])

    def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entry each copy is of, and its number."""
        of = np.repeat(np.arange(len(count)), count)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                for dim, part in vc.by_dim(whole.slice(start, _CHUNK)):
                    if dim not in plan:
                        continue
                    g = plan[dim]
                    column = lambda name: part.column(part.schema.get_field_index(name))
                    number = column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
                    cell, apart = column("cell").to_numpy(), column("apart").to_numpy()
                    needed = np.zeros((part.num_rows, len(g.cells)), bool)
                    for c in np.unique(cell):
                        at = cell == c
                        needed[at] = (apart[at, None] >= g.low[c]) & (apart[at, None] <= g.high[c])
                    at, unit = np.nonzero(needed)
                    of, query_slice = spread(g.query_slices[unit])
                    at, unit = at[of], unit[of]
                    yield from rows_of(part, at, unit, query_slice, (number[at] % g.data_slices[unit].astype(np.uint64)).astype(np.int64), 1)
                    asked = np.flatnonzero(column("query_cell").is_valid().to_numpy(zero_copy_only=False))
                    if len(asked):
                        unit = np.searchsorted(g.cells, column("query_cell").to_numpy(zero_copy_only=False)[asked].astype(np.int64))
                        of, data_slice = spread(g.data_slices[unit])
                        unit, asked = unit[of], asked[of]
                        yield from rows_of(part, asked, unit, (number[asked] % g.query_slices[unit].astype(np.uint64)).astype(np.int64), data_slice, 0)

    return located.mapInArrow(deal, schema)


class _Unit:
    """The queries of a unit and the best k rows of each among those seen so far."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.parts, self.rows = dim, k, [], None
        self.found: list[tuple] = []
        self.held = 0

    def ask(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _begin(self, space: vc.Space, within: float) -> None:
        asked = pa.Table.from_batches(self.parts).combine_chunks()
        self.rows = asked["row"].to_numpy()
        self.ids = asked["id"].combine_chunks()
        self.values = vc.decode(asked["vec"], self.dim)
        length = np.sqrt((self.values.astype(float) ** 2).sum(1))
        least = vc.scores_between(np.zeros(len(length)), np.full(len(length), within), length, space.most[self.dim])[0] if np.isfinite(within) else np.full(len(length), -np.inf)
        # all of a query's best rows score at least this
        self.least = np.where(np.isfinite(least), np.floor(least - 1e-6 * (np.abs(least) + 1)), -(2.0**63)).astype(np.int64)
        self.place = np.argsort(self.rows)

    def see(self, batch: pa.RecordBatch, space: vc.Space, within: float) -> None:
        if self.rows is None:
            if not self.parts:
                return
            self._begin(space, within)
        step = max(64, SCORES // len(self.rows))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            rows, ids = part.column(5).to_numpy(), part.column(6)
            scores = vc.inner_products(self.values, vc.decode(part.column(7), self.dim))
            spot = np.minimum(np.searchsorted(self.rows, rows, sorter=self.place), len(self.rows) - 1)
            own = self.place[spot]
            itself = np.flatnonzero(self.rows[own] == rows)
            fits = scores >= self.least[:, None]
            fits[own[itself], itself] = False
            if fits.sum() > 4 * self.k * len(self.rows) and len(rows) > self.k + 1:
                # the (k + 1)-th best of these rows, the query itself perhaps among them, is beaten by k others
                self.least = np.maximum(self.least, np.partition(scores, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1])
                fits &= scores >= self.least[:, None]
            query, data = np.nonzero(fits)
            self.found.append((query, scores[query, data], ids.take(pa.array(data))))
            self.held += len(query)
            if self.held > 2 * self.k * len(self.rows) + (1 << 18):
                self._compact()

    def _compact(self) -> None:
        query = np.concatenate([f[0] for f in self.found])
        score = np.concatenate([f[1] for f in self.found])
        ids = pa.concat_arrays([f[2] for f in self.found])
        null, value = vc.order_of(ids)
        order = np.lexsort((value, null, -score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        last = np.arange(len(query)) - first == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.found = [(query[keep], score[keep], ids.take(pa.array(order[keep])))]
        self.held = int(keep.sum())

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._compact()
            query, score, ids = self.found[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.rows[query]), self.ids.take(pa.array(query)), ids, pa.array(score)], names=["query_row", "query_id", "id", "score"])


def top_k(
    rows: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE, seed: int = 7,
    query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK,
) -> DataFrame:
    """(query_row, query_id, rank, id, score): each query's ``k`` other rows of the largest inner product.

    ``rows`` come from ``vectors.whole_numbers`` with a column ``id``; queries are those where ``is_query`` holds.
    Ties go to the smaller id, null after all others. Every row of the query's dimension but the query's own row
    is a candidate; rows of equal id or content are rows of their own. A query with fewer candidates gets them
    all. Without rows or queries there are no rows. Pivots are chosen from a seeded sample of ``sample`` rows; the
    choice changes the work, not the result.
    """
    space = vc.Space(rows, pivots, sample, seed)
    located = _locate(rows, is_query, space)
    plan = _plan(space, located, k, query_block, data_block)
    id_type = rows.schema["id"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, unit = None, None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(5)])
            cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = tuple(int(x) for x in marks[:4, a])
                if here != name:
                    if unit is not None:
                        yield from unit.best()
                    name, unit = here, _Unit(here[0], k)
                part = batch.slice(a, b - a)
                if marks[4, a]:
                    unit.see(part, space, float(plan[here[0]].within[here[1]]))
                else:
                    unit.ask(part)
        if unit is not None:
            yield from unit.best()

    dealt = _deal(located, plan).repartition(*_UNIT).sortWithinPartitions(*_UNIT, "is_data")
    found = dealt.mapInArrow(solve, f"query_row bigint, query_id {id_type}, id {id_type}, score bigint")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "id", "score")
