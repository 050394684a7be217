"""Deterministic draws from integer hashing: the same (seed, ids) give the same value anywhere.

No generator state is carried between rows or partitions, so a retried task draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the 32-bit mixing function.
MIX, SPREAD, STREAM, SEED_STEP, SPAN = 73244475, 2654435761, 40503, 9973, 4294967296


def hash32(row: Column, stream: Column | int, seed: int) -> Column:
    """A well-mixed integer in [0, 2^32) for any ``row`` from 0 to 2^62."""
    stream = F.lit(stream) if isinstance(stream, int) else stream
    row = row.cast("long")
    # the high part of a row number is spread on its own, so no product leaves 64 bits
    x = (row.bitwiseAND(2**31 - 1) * SPREAD + F.shiftright(row, 31) % SPAN * MIX + stream.cast("long") * STREAM + seed * SEED_STEP) % SPAN
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * MIX) % SPAN
    return F.shiftright(x, 16).bitwiseXOR(x)


def uniform(row: Column, stream: Column | int, seed: int) -> Column:
    return hash32(row, stream, seed) / F.lit(float(SPAN))


def below(n: Column, row: Column, stream: Column | int, seed: int) -> Column:
    """A uniform integer in [0, n)."""
    return hash32(row, stream, seed) % n
