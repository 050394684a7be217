"""The chain of accepted rebalances: pointers over chunks against a plain walk."""

import numpy as np
import pytest

from tidemark.operators import series
from tidemark.operators.rebalance import accept_targets, first_outside


def plain(rows, threshold):
    """rows of (portfolio, check, symbol, weight) that are taken, walked one by one."""
    checks, taken, held, last = {}, [], None, None
    for p, c, s, w in rows:
        if w is not None and w == w:
            checks.setdefault((p, c), {})[s] = w
    for (p, c), target in sorted(checks.items()):
        if p != last or set(target) != set(held) or max(abs(target[s] - held[s]) for s in target) > threshold:
            last, held = p, target
            taken += [(p, c, s, w) for s, w in target.items()]
    return sorted(taken)


def walked_rows(rng, n, members, step, name):
    w = np.round(0.5 + np.cumsum(rng.normal(0, step, (n, members)), axis=0), 3)
    return [(name, 24 * i, f"s{j}", float(w[i, j])) for i in range(n) for j in range(members)]


@pytest.mark.parametrize("chunk", [4, 16, 4096])
def test_pointers_and_walk_take_the_same_checks(spark, monkeypatch, chunk):
    monkeypatch.setattr(series, "CHUNK_BARS", chunk)
    rng = np.random.default_rng(5)
    rows = walked_rows(rng, 90, 3, 0.01, "wild") + walked_rows(rng, 70, 2, 0.0004, "calm") + walked_rows(rng, 1, 2, 0.1, "one")
    # a portfolio that never moves, one that moves once, late, and one whose weights stay exactly at the threshold
    rows += [("still", i, "s0", 0.5) for i in range(60)]
    rows += [("late", i, s, 0.5 if i < 57 else 0.6) for i in range(60) for s in ("s0", "s1")]
    rows += [("edge", i, "s0", 0.25 * (i % 2)) for i in range(40)]
    # members come and go, and go for the length of several chunks
    rows += [("ragged", i, s, 0.3 + 0.001 * i) for i in range(64) for s in ("s0", "s1", "s2") if s != "s2" or i % 23 < 11]
    rows += [("missing", i, s, None if s == "s1" and i in (3, 4) else float("nan") if s == "s1" and i == 9 else 0.5) for i in range(12) for s in ("s0", "s1")]
    frame = spark.createDataFrame(rows, "portfolio string, check long, symbol string, weight double").repartition(5)
    for threshold in (0.02, 0.25, 0.0):
        got = sorted(tuple(r) for r in accept_targets(frame, threshold).collect())
        assert got == plain(rows, threshold)


def test_no_targets(spark, small_chunks):
    assert accept_targets(spark.createDataFrame([], "portfolio string, check long, symbol string, weight double")).count() == 0


def test_first_outside_is_the_first():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        values = np.round(rng.random(n), 2)
        of, start = np.round(rng.random(50), 2), rng.integers(0, n + 1, 50)
        for band in (0.0, 0.3, 0.9):
            want = [next((i for i in range(s, n) if abs(values[i] - x) > band), n) for x, s in zip(of, start)]
            assert first_outside(values, of, start, band).tolist() == want
