"""Vectors as whole numbers: scaling, narrow storage, exact inner products, and pivots.

A vector is kept as bytes of the narrowest signed integers that hold it, so what is shuffled is as small as
the values allow. Inner products are exact: they are taken in doubles where no partial sum can leave 2**53,
else in Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.tables import seeded_sample
from tidemark.plans.staging import stage

_WIDTHS = [np.int8, np.int16, np.int32, np.int64]
#: Rows kept, and what is known of each: a number of the row, its length and its squared length as a vector.
VECTOR_COLUMNS = "row bigint, dim int, norm2 double, vec binary"


def encode(values: np.ndarray) -> bytes:
    most = int(np.abs(values).max(initial=0))
    kind = next(w for w in _WIDTHS if most <= np.iinfo(w).max)
    return values.astype(kind).tobytes()


def decode(vectors: pa.Array | list, dim: int) -> np.ndarray:
    """Rows x dim of int64; all vectors have ``dim`` components."""
    raw = vectors.to_pylist() if hasattr(vectors, "to_pylist") else vectors
    out = np.empty((len(raw), dim), np.int64)
    if not dim:
        return out
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // dim
    for kind in _WIDTHS:
        at = np.flatnonzero(sizes == np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim)
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` and ``b`` as int64; a product beyond a long is an error."""
    if a.shape[1] == 0 or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if any(abs(x) >= 2**63 for x in exact.ravel()):
        raise ValueError("an inner product does not fit a long")
    return exact.astype(np.int64)


def whole_numbers(rows: DataFrame, vector: str, scale: int, keep: list[str]) -> DataFrame:
    """``keep`` and VECTOR_COLUMNS of the rows whose vector is whole, written to a table.

    Each component x becomes floor(scale * x), x as double. Rows whose vector is null or holds null or
    non-finite components are left out; an empty vector is one of no components. ``row`` numbers the rows of
    the written table, so rows of equal content stay apart.
    """
    chosen = rows.select(*keep, F.col(vector).alias("_vector"))
    fields = [f for f in chosen.schema.fields if f.name != "_vector"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["dim int, norm2 double, vec binary"])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().cast(pa.float64())
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False))  # a null component comes as NaN
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
            if (np.abs(np.where(np.isfinite(x), x, 0)) >= 2.0**62).any():
                raise ValueError("a scaled component does not fit a long")
            parts = [x[e - n : e] for e, n, w in zip(ends, sizes, whole) if w]
            kept = [batch.column(i).filter(pa.array(whole)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(p) for p in parts], pa.int32()), pa.array([float(p @ p) for p in parts], pa.float64()),
                 pa.array([encode(p.astype(np.int64)) for p in parts], pa.binary())],
                names=[*(f.name for f in fields), "dim", "norm2", "vec"])

    return stage(chosen.mapInArrow(scaled, schema).withColumn("row", F.monotonically_increasing_id()))


class Space:
    """Where inner products are distances, and pivots in it.

    A row of length |s| gets the component sqrt(M2 - |s|^2), with M2 the largest squared length among rows of
    its dimension; a query is stretched to length M. All then lie on a sphere, and a larger inner product is a
    shorter distance. Pivots are chosen among a bounded sample, each the farthest from those before it; of
    dimensions that the sample misses there are none, and rows of them go to cell -1, which is never ruled out.
    """

    def __init__(self, rows: DataFrame, pivots: int, sample: int, seed: int):
        self.most = {r[0]: float(r[1]) for r in rows.groupBy("dim").agg(F.max("norm2")).collect()}
        picked = rows.join(F.broadcast(seeded_sample(rows, sample, seed, "row")), "row").select("row", "dim", "vec").collect()
        picked = sorted(picked, key=lambda r: r["row"])
        self.pivots: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        n = 0
        for dim in sorted({r["dim"] for r in picked}):
            here = [r["vec"] for r in picked if r["dim"] == dim]
            points = self.lifted(decode(here, dim), dim)
            share = max(1, pivots * len(here) // len(picked))
            chosen = [0]
            gap = distances(points, points[:1])[:, 0]
            while len(chosen) < share and gap.max() > 0:
                chosen.append(int(gap.argmax()))
                gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
            self.pivots[dim], self.first[dim] = points[chosen], n
            n += len(chosen)
        self.n = n

    def lifted(self, values: np.ndarray, dim: int) -> np.ndarray:
        x = values.astype(float)
        rest = np.sqrt(np.maximum(self.most[dim] - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def stretched(self, values: np.ndarray, dim: int) -> np.ndarray:
        x = values.astype(float)
        norm = np.sqrt((x * x).sum(1))
        x = x * (np.sqrt(self.most[dim]) / np.where(norm > 0, norm, 1.0))[:, None]
        return np.column_stack([x, np.zeros(len(x))])

    def slack(self, dim: int) -> float:
        """What rounding may add to a distance, with a wide margin."""
        return 1e-6 * np.sqrt(self.most[dim]) + 1e-9

    def nearest(self, points: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point and the distance to its pivot."""
        if dim not in self.pivots:
            return np.full(len(points), -1), np.zeros(len(points))
        apart = distances(points, self.pivots[dim])
        cell = apart.argmin(1)
        return cell + self.first[dim], apart[np.arange(len(points)), cell]

    def dim_of(self, cell: int) -> int:
        return max((d for d in self.first if self.first[d] <= cell), key=lambda d: self.first[d])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def scores_between(near: np.ndarray, far: np.ndarray, length: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product of a query of this length with points ``near`` to ``far`` away from its stretched form."""
    half = length / (2 * np.sqrt(most)) if most > 0 else 0.0 * length
    return half * (2 * most - far * far), half * (2 * most - near * near)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows of each dimension apart."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch if len(dims) and (dims == dim).all() else batch.filter(pa.array(dims == dim))


def order_of(ids: pa.Array) -> np.ndarray:
    """Ids as places in their order; null after all others."""
    values = ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), values])


def divisible(name: str, by: int) -> Column:
    return F.col(name) % by == 0
