"""Reading the given tables and registering the queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores behind it until none of the frames has such a column (case apart)."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def seeded_sample(rows: DataFrame, most: int, seed: int, by: str = "doc_id") -> DataFrame:
    """At most ``most`` distinct values of ``by``, those of the smallest seeded hash: the same at every layout.

    Of many rows only those under a bound of the hash are ordered, about twice as many as wanted, so what
    is sorted does not grow with the number of partitions. Nulls are left out.
    """
    span = 2**40
    place = F.pmod(F.xxhash64(by, F.lit(seed)), F.lit(span))
    ids = rows.where(F.col(by).isNotNull())
    n = ids.count()
    if n > 2 * most:
        ids = ids.where(place < int(span * 2 * most / n))
    return ids.select(by).distinct().orderBy(place, by).limit(most)
