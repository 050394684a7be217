"""Live kline messages to bar rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.schema import BAR_COLUMNS
from tidemark.sources.ticks import from_epoch_ms

# Message key -> (bar column, type).
FIELDS = {
    "t": ("open_time", "long"), "T": ("close_time", "long"), "o": ("open", "double"), "h": ("high", "double"),
    "l": ("low", "double"), "c": ("close", "double"), "v": ("volume", "double"), "q": ("quote_volume", "double"),
    "n": ("trades", "long"),
}


def parse_payloads(messages: DataFrame, value: str = "value") -> DataFrame:
    """Bar columns, ``is_final`` and ``error`` per message; works on batches and streams.

    Text that is not JSON, or has no ``k`` object, is dropped.  A message lacking required keys or
    holding unreadable numbers stays with ``error`` set.
    """
    kept = [c for c in messages.columns if c != value]
    k = F.from_json(value, "k map<string,string>")["k"]
    d = messages.withColumn("_k", k).where(F.col("_k").isNotNull())
    needed = F.array(*[F.lit(name) for name in sorted(FIELDS)])
    lacking = F.array_except(needed, F.map_keys("_k"))

    def read(name: str, kind: str) -> Column:
        text = F.col("_k")[name]
        if kind == "long":
            return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
        return text.try_cast("double")

    values = {column: read(name, kind) for name, (column, kind) in FIELDS.items()}
    unreadable = F.exists(F.array(*[v.isNull() for v in values.values()]), lambda b: b)
    error = F.when(
        F.size(lacking) > 0, F.concat(F.lit("payload lacks "), F.array_join(lacking, ", "))
    ).when(unreadable, F.lit("payload cannot be read"))
    for column in ("open_time", "close_time"):
        values[column] = from_epoch_ms(values[column])
    final = F.coalesce(F.lower(F.col("_k")["x"]) == "true", F.lit(False))
    return d.select(*kept, *[values[c].alias(c) for c in BAR_COLUMNS], final.alias("is_final"), error.alias("error"))


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows)."""
    return parsed.where(F.col("error").isNull()).drop("error"), parsed.where(F.col("error").isNotNull())
