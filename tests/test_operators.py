"""Exact small cases and chunk-border checks on Spark."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import align, backtest as bt, metrics as mt, montecarlo as mc, portfolio as pf, rolling
from tidemark.operators.series import chunk_window, drop_halo, ewm_mean, lay_out, running, trailing, with_ordinal
from tidemark.plans import optimise as op
from tidemark.schema import SERIES
from tidemark.sources import store, ticks as tk


def bars_of(spark, closes, symbol="a", **columns):
    n = len(closes)
    times = pd.date_range("2024-01-01", periods=n, freq="h")
    pdf = pd.DataFrame({
        "symbol": symbol, "interval": "1h", "open_time": times, "open": closes, "high": np.asarray(closes) + 1.0,
        "low": np.asarray(closes) - 1.0, "close": closes, "volume": 1.0, "quote_volume": 1.0, "trades": 1,
        "close_time": times + pd.Timedelta(hours=1) - pd.Timedelta(milliseconds=1), **columns,
    })
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("open_time", "close_time")})


def walk(n, seed):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))


def test_ordinal_is_dense_and_ordered(spark):
    d = with_ordinal(bars_of(spark, walk(2000, 1))).toPandas().sort_values("open_time")
    assert d["bar_idx"].tolist() == list(range(2000)) and set(d["n_bars"]) == {2000}


def test_windows_with_halo_match_pandas(spark, small_chunks):
    x = walk(300, 2)
    laid = lay_out(with_ordinal(bars_of(spark, x)), back=19, ahead=1)
    laid = laid.withColumn("sd", F.stddev_samp("close").over(trailing(SERIES, 20)))
    laid = laid.withColumn("next", F.lead("close").over(chunk_window()))
    got = drop_halo(laid).toPandas().sort_values("bar_idx")
    assert len(got) == 300
    assert np.allclose(got["sd"][1:], pd.Series(x).rolling(20, min_periods=1).std()[1:])
    assert np.allclose(got["next"][:-1], x[1:])


def test_running_kinds_match_pandas(spark, small_chunks):
    x = walk(300, 3) / 100
    sparse = F.when(F.col("bar_idx") % 23 == 5, F.col("close"))
    got = running(with_ordinal(bars_of(spark, x)), {
        "s": ("sum", F.col("close")), "p": ("product", F.col("close")), "hi": ("max", F.col("close")),
        "lo": ("min", F.col("close")), "l": ("last", sparse), "f": ("first", sparse),
    }).toPandas().sort_values("bar_idx")
    s = pd.Series(x)
    held = s.where(s.index % 23 == 5)
    for name, want in {"s": s.cumsum(), "p": s.cumprod(), "hi": s.cummax(), "lo": s.cummin(), "l": held.ffill()}.items():
        assert np.allclose(got[name], want, equal_nan=True), name
    assert got["f"].dropna().unique().tolist() == [x[5]] and got["f"].isna().sum() == 5


@pytest.mark.parametrize("span", [1, 2, 14, 700])
def test_ewm_matches_pandas(spark, small_chunks, span):
    x = np.abs(walk(900, 4))
    got = ewm_mean(with_ordinal(bars_of(spark, x)), "close", span, "y").toPandas().sort_values("bar_idx")
    assert np.allclose(got["y"], pd.Series(x).ewm(span=span, adjust=False).mean(), rtol=1e-11)


def replay(signals, x, f):
    """Sequential account used as the yardstick."""
    cash, units, equity, n = 10000.0, 0.0, [], len(x)
    for i in range(n):
        equity.append(cash + units * x[i])
        if i == n - 1:
            break
        if signals[i] == 1 and units == 0:
            spend = cash * f
            units = spend / (x[i + 1] * 1.0005 * 1.001)
            cash -= spend
        elif signals[i] == -1 and units > 0:
            cash += units * x[i + 1] * 0.9995 * 0.999
            units = 0.0
    return np.array(equity)


@pytest.mark.parametrize("f", [1.0, 0.7])
@pytest.mark.parametrize("seed", range(4))
def test_positions_equal_the_sequential_account(spark, small_chunks, f, seed):
    x = walk(260, seed)
    rng = np.random.default_rng(seed)
    sig = rng.choice([0, 1, -1], 260, p=[0.9, 0.05, 0.05] if seed % 2 else [0.3, 0.35, 0.35])
    d = bt.with_previous_signal(with_ordinal(bars_of(spark, x, signal=sig)))
    pos = bt.positions(d, account=bt.Account(fraction=f))
    got = pos.toPandas().sort_values("bar_idx")
    want = replay(sig, x, f)
    assert np.allclose(got["equity"], want, rtol=1e-12)
    assert np.allclose(got["drawdown"], want - np.maximum.accumulate(want), atol=1e-7)
    assert np.allclose(got["ret"][1:], want[1:] / want[:-1] - 1, atol=1e-12)
    trades = bt.closed_trades(pos, account=bt.Account(fraction=f)).toPandas().sort_values("entry_idx")
    assert (trades["entry_idx"].to_numpy()[1:] >= trades["exit_idx"].to_numpy()[:-1]).all()


def test_relational_and_walked_backtests_agree(spark, small_chunks):
    x = walk(200, 9)
    sig = np.random.default_rng(9).choice([0, 1, -1], 200)
    d = with_ordinal(bars_of(spark, x, signal=sig))
    pos = bt.positions(bt.with_previous_signal(d))
    equity, trades = bt.replay(d)
    a = pos.select("bar_idx", "equity").toPandas().sort_values("bar_idx")
    b = equity.select("bar_idx", "equity").toPandas().sort_values("bar_idx")
    assert np.allclose(a["equity"], b["equity"], rtol=1e-11)
    assert trades.count() == bt.closed_trades(pos).count()


def test_time_exit(spark):
    x = np.full(60, 100.0)
    sig = np.zeros(60, int)
    sig[5] = 1
    _, trades = bt.replay(with_ordinal(bars_of(spark, x, signal=sig)), account=bt.Account(max_bars=15))
    row = trades.collect()[0]
    assert row["exit_reason"] == "time" and row["entry_idx"] == 6 and row["bars_held"] == 16


def test_excursions_exact(spark):
    bars = with_ordinal(bars_of(spark, [100.0] * 5, high=[100, 102, 105, 103, 101], low=[99, 100, 102, 101, 99]))
    t = spark.createDataFrame([("a", "1h", 0, 4, 100.0, 1)], "symbol string, interval string, entry_idx long, exit_idx long, entry_price double, direction int")
    assert bt.mae_mfe(t, bars.withColumns({c: F.col(c).cast("double") for c in ("high", "low")})).select("mae", "mfe").collect()[0] == (1.0, 5.0)
    short = t.withColumn("direction", F.lit(-1))
    assert bt.mae_mfe(short, bars).select("mae", "mfe").collect()[0] == (5, 1)


def test_drawdown_exact(spark):
    d = mt.with_drawdown(with_ordinal(bars_of(spark, [100.0, 110, 105, 115, 100, 120])), "close")
    row = d.groupBy("symbol").agg(*[c.alias(n) for n, c in mt.max_drawdown_columns().items()]).collect()[0]
    assert row["max_drawdown"] == -15 and row["max_drawdown_pct"] == pytest.approx(-15 / 115)


def test_sortino_edges(spark):
    d = spark.createDataFrame([("none", 0.1), ("none", 0.2), ("one", -0.1), ("one", 0.2), ("flat", -0.1), ("flat", -0.1), ("flat", 0.1)], "k string, r double")
    got = {r["k"]: r["s"] for r in d.groupBy("k").agg(mt.sortino("r", 252).alias("s")).collect()}
    assert got["none"] == float("inf") and got["one"] is None and got["flat"] == float("inf")


def test_sizing_exact(spark):
    d = spark.range(1).select(
        fx.fixed_risk_size(F.lit(10000.0), F.lit(100.0), F.lit(95.0), 0.01).alias("a"),
        fx.fixed_risk_size(F.lit(10000.0), F.lit(100.0), F.lit(100.0), 0.01).alias("b"),
        *[fx.pyramid_size(F.lit(10.0), F.lit(v), 3).alias(f"p{int(v)}") for v in (10.0, 15.0, 25.0)],
    )
    assert tuple(d.collect()[0]) == (20.0, 0.0, 5.0, 5.0, 0.0)


def test_entry_spacing(spark):
    sig = [0, 1, 0, 1, 0, 0, 1, 0, 0, 1]
    got = rolling.space_entries(with_ordinal(bars_of(spark, [1.0] * 10, signal=sig)), 3).orderBy("bar_idx")
    assert [r["spaced"] for r in got.collect()] == [0, 1, 0, 0, 0, 0, 1, 0, 0, 1]


def test_asof_takes_the_first_bar_before_any(spark):
    low = bars_of(spark, [1.0, 2, 3, 4]).select("symbol", "open_time")
    high = bars_of(spark, [10.0, 20, 30, 40]).where("close in (20, 40)").select("symbol", "open_time", "close")
    got = align.asof_join(low, high, "4h").orderBy("open_time").collect()
    assert [r["close_4h"] for r in got] == [20, 20, 20, 40]


def test_store_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert store.read_bars(spark, path) is None
    first = bars_of(spark, [1.0, 2, 3, 4])
    store.write_bars(first, path)
    late = bars_of(spark, [1.0, 2, 3, 4, 5]).where("close >= 3").withColumn("close", F.col("close") * 10)
    store.merge_bars(spark, path, late, str(tmp_path / "staging"))
    rows = store.read_bars(spark, path).orderBy("open_time").collect()
    assert [r["close"] for r in rows] == [1, 2, 30, 40, 50]
    with pytest.raises(ValueError):
        store.in_range(first, "2024-01-02", "2024-01-01")


def test_gaps(spark):
    holes = bars_of(spark, [1.0] * 9).where("hour(open_time) not in (5, 6)")
    rows = store.find_gaps(holes, "1h").collect()
    assert len(rows) == 1 and str(rows[0]["gap_end"]) == "2024-01-01 07:00:00"


def test_raw_record(spark):
    raw = spark.createDataFrame([(["1609459200000", "29000", "x", "28800.5", "29200", "100.5", "1609462799999", "2.5", "7", "0", "0", "0"],)], "kline array<string>")
    row = tk.klines_to_bars(raw).collect()[0]
    assert str(row["open_time"]) == "2021-01-01 00:00:00" and row["high"] is None and row["trades"] == 7
    assert str(row["close_time"]) == "2021-01-01 00:59:59.999000"


def test_walk_windows(spark):
    n = spark.createDataFrame([("a", 1000)], "symbol string, n_bars long")
    rows = op.walk_windows(n, 300, 100).orderBy("window_id").collect()
    assert len(rows) == 7 and all(r["train_end"] - r["train_start"] == 300 and r["train_end"] == r["test_start"] for r in rows)
    anchored = op.walk_windows(n, 300, 100, anchored=True).collect()
    assert {r["train_start"] for r in anchored} == {0} and len(anchored) == 7
    assert op.walk_windows(n, 900, 200).count() == 0


@pytest.mark.parametrize("block", [5, 7, 0, 200])
def test_block_metrics_equal_the_simulated_curves(spark, block):
    r = np.random.default_rng(5).normal(0, 0.01, 103)
    d = spark.createDataFrame(pd.DataFrame({"symbol": "a", "interval": "1h", "idx": np.arange(103), "ret": r}))
    curves = mc.block_bootstrap(d, "ret", 12, block, 3)
    a = mc.curve_metrics(curves, 9000.0).toPandas().sort_values("sim_id")
    b = mc.bootstrap_metrics(d, 9000.0, n_sims=12, block=block, seed=3).toPandas().sort_values("sim_id")
    for m in mc.MC_METRICS:
        assert np.allclose(a[m], b[m], rtol=1e-9), m
    if block != 200:
        assert curves.groupBy("sim_id").count().where("count <> 103").count() == 0


def test_weights_and_shape(spark):
    w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.3), ("p", "c", 0.2)], "portfolio string, symbol string, weight double")
    row = pf.concentration(w).collect()[0]
    assert row["max_weight"] == 0.5 and row["top3_concentration"] == pytest.approx(1.0)
    cov = spark.createDataFrame([("p", i, j, 0.01 if i == j else 0.005) for i in "ab" for j in "ab"], "portfolio string, sym_i string, sym_j string, value double")
    half = w.where("symbol < 'c'").withColumn("weight", F.lit(0.5))
    assert pf.portfolio_volatility(half, cov).collect()[0]["volatility"] == pytest.approx(np.sqrt(0.0075))
    keep = pf.rebalance(half, half.withColumn("weight", F.when(F.col("symbol") == "a", 0.52).otherwise(0.48)))
    assert not keep.collect()[0]["rebalanced"]
    assert pf.rebalance(half, w).collect()[0]["rebalanced"]


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_correlation_with_ties_matches_pandas(spark, method):
    v = np.round(np.random.default_rng(8).normal(0, 1, (200, 3)), 1)
    v[:80, 0] = 0.0  # a heavy tie
    long = pd.DataFrame([("p", s, t, v[t, i]) for i, s in enumerate("abc") for t in range(200)], columns=["portfolio", "symbol", "t", "ret"])
    got = pf.correlation(spark.createDataFrame(long), method).toPandas().set_index(["sym_i", "sym_j"])["corr"]
    ranked = pd.DataFrame(v, columns=list("abc"))
    want = (ranked.rank() if method == "spearman" else ranked).corr()
    for (i, j), c in got.items():
        assert c == pytest.approx(want.loc[i, j], abs=1e-12)


@pytest.mark.parametrize("cutoff", [0.08, 0.5, 1.0])
def test_spread_smoothing_equals_the_transform(spark, monkeypatch, cutoff):
    """Series of odd, even and prime length over several blocks of columns and rows, next to a short one."""
    from tidemark.operators import series
    from tidemark.operators.smooth import low_pass, smooth

    monkeypatch.setattr(series, "CHUNK_BARS", 8)  # blocks of 512 numbers, series of more than 128 bars are long
    lengths = {"a": 691, "b": 800, "c": 129, "d": 90}
    lines = {s: walk(n, n) for s, n in lengths.items()}
    d = None
    for s, v in lines.items():
        one = bars_of(spark, v, s)
        d = one if d is None else d.unionByName(one)
    got = smooth(with_ordinal(d), F.lit(cutoff)).toPandas().sort_values(["symbol", "bar_idx"])
    want = np.concatenate([low_pass(v, cutoff) for v in lines.values()])
    assert got["symbol"].value_counts().to_dict() == lengths
    assert np.allclose(got["smoothed"], want, rtol=1e-11)


def test_spread_spectrum_equals_the_transform(spark, monkeypatch):
    from tidemark.operators import series, spectral

    monkeypatch.setattr(series, "CHUNK_BARS", 8)
    lines = {"a": walk(691, 1), "b": walk(512, 2), "c": walk(40, 3), "d": walk(1, 4), "e": walk(2, 5)}
    d = None
    for s, v in lines.items():
        one = bars_of(spark, v, s)
        d = one if d is None else d.unionByName(one)
    got = spectral.fft_spectrum(with_ordinal(d)).toPandas().sort_values(["symbol", "k"])
    for s, v in lines.items():
        k = np.arange(1, (len(v) - 1) // 2 + 1)
        mine = got[got["symbol"] == s]
        assert mine["k"].tolist() == k.tolist() and np.allclose(mine["freq"], k / len(v))
        assert np.allclose(mine["power"], np.abs(np.fft.fft(v - v.mean()))[k] ** 2, rtol=1e-8)


@pytest.mark.parametrize("window,overlap", [(16, 0.5), (16, 0.9), (15, 0.0), (200, 0.5), (1, 0.0)])
def test_windows_over_chunks_equal_plain_windows(spark, monkeypatch, window, overlap):
    from tidemark.operators import series, spectral

    monkeypatch.setattr(series, "CHUNK_BARS", 16)
    lines = {"a": walk(150, 1), "b": walk(63, 2), "c": walk(3, 3)}
    d = None
    for s, v in lines.items():
        one = bars_of(spark, v, s)
        d = one if d is None else d.unionByName(one)
    d = with_ordinal(d)
    got = spectral.welch_psd(d, window=window, overlap=overlap).toPandas().sort_values(["symbol", "k"])
    periods = spectral.sliding_dominant_period(d, window=window, overlap=overlap).toPandas().sort_values(["symbol", "window_id"])
    for s, v in lines.items():
        w = min(window, len(v))
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / w) if w > 1 else np.ones(1)

        def plain(start):
            x = v[start : start + w]
            psd = np.abs(np.fft.rfft((x - x.mean()) * taper)) ** 2 / (taper**2).sum()
            psd[1 : (w + 1) // 2] *= 2
            return psd

        mine = got[got["symbol"] == s]
        want = np.mean([plain(i) for i in range(0, len(v) - w + 1, w - int(w * overlap))], axis=0)
        assert np.allclose(mine["psd"], want) and np.allclose(mine["freq"], np.arange(len(want)) / w)
        starts = range(0, len(v) - w + 1, max(1, int(w * (1 - overlap))))
        peaks = [w / (plain(i)[1:].argmax() + 1) for i in starts] if w > 1 else []
        mine = periods[periods["symbol"] == s]
        assert np.allclose(mine["period"], peaks) and mine["center_idx"].tolist() == [i + w // 2 for i in starts][: len(peaks)]


def test_late_partial_bar_is_computed_anew(spark, tmp_path):
    from catalog.live import in_files
    from tidemark.plans.strategy import Trend
    from tidemark.streaming import live

    rng = np.random.default_rng(4)
    close = 100 + np.cumsum(rng.normal(size=400))
    frame = pd.DataFrame({"symbol": "s", "interval": "1h", "open_time": pd.date_range("2024-01-01", periods=400, freq="h"), "open": close, "high": close + 1, "low": close - 1, "close": close})
    first = spark.createDataFrame(frame).withColumns({"close_time": F.expr("open_time + interval 1 hour"), "volume": F.lit(1.0), "quote_volume": F.lit(1.0), "trades": F.lit(1).cast("bigint")})
    first = first.withColumns({"is_final": F.lit(True), "seq": F.lit(0), "_turn": F.lit(0.0)})
    second = first.where("open_time = timestamp'2024-01-02 00:00:00'").withColumns({"close": F.col("close") * 1.5, "is_final": F.lit(False), "seq": F.lit(1), "_turn": F.lit(0.5)})
    path, out, rule = in_files(first.unionByName(second), 2), str(tmp_path), Trend()
    live.refresh_stream(live.read_stream(spark, path, spark.read.parquet(path).schema), f"{out}/bars", f"{out}/signals", f"{out}/ckpt", rule).awaitTermination()
    want = {r["open_time"]: r["smoothed"] for r in live.full_refresh(with_ordinal(store.read_bars(spark, f"{out}/bars")), rule).collect()}
    got = {r["open_time"]: r["smoothed"] for r in spark.read.parquet(f"{out}/signals").collect()}
    assert len(got) == 400 and got == pytest.approx(want, nan_ok=True)


class Died(Exception):
    pass


@pytest.fixture(scope="module")
def refreshed(spark):
    """(signals, rows touched) after two batches; the second, with bars of three series, may die after a step and be replayed."""
    from tidemark.plans.staging import fresh_folder
    from tidemark.plans.strategy import Trend
    from tidemark.streaming import live

    every = None
    for k, symbol in enumerate("abc"):
        one = bars_of(spark, walk(1500, k), symbol)
        every = one if every is None else every.unionByName(one)
    every = with_ordinal(every).withColumns({"is_final": F.lit(True), "seq": F.col("bar_idx")})
    update = every.withColumns({"close": F.col("close") + 1, "is_final": F.lit(False), "seq": F.lit(5000)})
    # a: a new partial bar; b: updates within the reach; c: one before it
    second = update.where("(symbol = 'a' and bar_idx >= 1490) or (symbol = 'b' and bar_idx between 1480 and 1498) or (symbol = 'c' and bar_idx in (700, 1498))")

    def run(dies_after=None):
        out = fresh_folder(spark, "test")
        refresh = live.LiveRefresh(f"{out}/bars", f"{out}/signals", f"{out}/ckpt", Trend(min_trend_bars=12, window=10))
        refresh(every.where("bar_idx < 1499"), 0)
        if dies_after:
            done = getattr(live.LiveRefresh, dies_after)

            def last_step(self, *args):
                done(self, *args)
                raise Died

            with pytest.MonkeyPatch.context() as m, pytest.raises(Died):
                m.setattr(live.LiveRefresh, dies_after, last_step)
                refresh(second, 1)
        refresh(second, 1)
        got = spark.read.parquet(f"{out}/signals").drop("month").toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
        return got, spark.read.parquet(f"{out}/signals-touched/batch=1").count()

    return run, run()


@pytest.mark.parametrize("dies_after", ["decide", "merge", "compute", "publish"])
def test_replayed_refresh_is_like_an_undisturbed_one(refreshed, dies_after):
    run, (want, n) = refreshed
    got, m = run(dies_after)
    assert n == m == 10 + 19 + 2
    pd.testing.assert_frame_equal(got, want)
    assert want.groupby("symbol").size().to_dict() == {"a": 1500, "b": 1499, "c": 1499}


def test_last_bars_come_from_the_last_months(spark):
    from tidemark.plans.staging import fresh_folder
    from tidemark.streaming import live

    path = fresh_folder(spark, "test")
    store.write_bars(bars_of(spark, walk(2000, 1), "a").unionByName(bars_of(spark, walk(5, 2), "b")), path)
    series = spark.createDataFrame([("a", "1h"), ("b", "1h"), ("c", "1h")], "symbol string, interval string")
    got = live.last_bars(spark, path, series, 300)
    rows = got.groupBy("symbol").agg(F.count("*"), F.min("bar_idx"), F.max("bar_idx"), F.max("n_bars")).orderBy("symbol").collect()
    assert [tuple(r) for r in rows] == [("a", 300, 1700, 1999, 2000), ("b", 5, 0, 4, 5)]


@pytest.mark.parametrize("reach", [1, 5, 40, 300])
def test_chains_over_chunks_equal_a_walk(spark, small_chunks, reach):
    """Holes without candidates, candidates that are busy past many chunks or for good, several series."""
    from tidemark.operators.chains import taken_in_turn

    rng = np.random.default_rng(reach)
    rows, want = [], set()
    for s in "abc":
        idx = np.flatnonzero(rng.random(600) < (0.7 if s == "a" else 0.1))
        idx = idx[(idx < 200) | (idx > 330)]
        free = [None if rng.random() < 0.002 else int(i + rng.integers(1, reach + 1)) for i in idx]
        rows += [(s, "1h", int(i), f) for i, f in zip(idx, free)]
        at = 0
        for i, f in zip(idx, free):
            if at is not None and i >= at:
                want.add((s, int(i)))
                at = f
    got = taken_in_turn(spark.createDataFrame(rows, "symbol string, interval string, bar_idx long, free long").repartition(7))
    assert {(r["symbol"], r["bar_idx"]) for r in got.collect()} == want


def test_replay_in_units_goes_on_after_a_refused_entry(spark, small_chunks):
    """Cash for one lot at low prices only: entries at high prices are refused and others taken later."""
    price = 100 + 60 * np.sin(np.arange(300) / 9.0)
    signal = np.where(np.arange(300) % 7 == 0, 1, np.where(np.arange(300) % 7 == 4, -1, 0))
    df = with_ordinal(bars_of(spark, price, signal=signal))
    account = bt.Account(capital=120.0, mode="fixed", fraction=1.0)
    got = bt.replay(df, account=account)[1].orderBy("entry_idx").toPandas()
    cash, want, i = 120.0, [], 0
    while i < 299:
        fill = price[i + 1] * 1.0005
        if signal[i] == 1 and fill * 1.001 <= cash:
            j = next((k for k in range(i + 1, 299) if signal[k] == -1), None)
            if j is None:
                break
            out = price[j + 1] * 0.9995
            cash += out * 0.999 - fill * 1.001
            want.append((i + 1, j + 1))
            i = j + 1
        else:
            i += 1
    assert list(zip(got["entry_idx"], got["exit_idx"])) == want and 0 < len(want) < 40


def test_inversions_of_all_lengths():
    from tidemark.operators.portfolio import inversions

    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 63, 64, 65, 200, 1000):
        v = rng.integers(0, 50, n).astype(float)
        assert inversions(v) == sum(int((v[i] > v[i + 1 :]).sum()) for i in range(n))


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlations_of_ragged_members_over_blocks(spark, monkeypatch, method):
    """Values of one octave, heavy ties, a constant, members of other bars, one with too few; small blocks and chunks."""
    from tidemark.operators import moments

    monkeypatch.setattr(moments, "CHUNK_TIMES", 50)
    monkeypatch.setattr(pf, "RANK_BLOCK", 8)
    rng = np.random.default_rng(12)
    base = rng.normal(size=400)
    v = pd.DataFrame({"a": 1.5 + base / 1e4, "b": np.round(base + rng.normal(size=400), 1), "c": np.where(rng.random(400) < 0.5, 0.0, base), "d": 7.0, "e": base**3})
    v.loc[v.index % 3 == 0, "b"] = np.nan
    v.loc[v.index > 20, "e"] = np.nan
    long = v.melt(ignore_index=False, var_name="symbol", value_name="ret").reset_index(names="t").dropna().assign(portfolio="p")
    got = pf.correlation(spark.createDataFrame(long), method).toPandas().set_index(["sym_i", "sym_j"])["corr"]
    assert len(got) == 15
    for (i, j), c in got.items():
        both = v[[i, j]].dropna() if i != j else v[[i, i]].dropna().set_axis(["a", "b"], axis=1)
        want = np.nan if len(both) < 30 or both.iloc[:, 0].nunique() == 1 or both.iloc[:, 1].nunique() == 1 else None
        if want is None and method == "kendall":
            x, y = both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy()
            sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
            want = (sx * sy).sum() / np.sqrt((sx**2).sum()) / np.sqrt((sy**2).sum())
        elif want is None:
            ranked = both.rank() if method == "spearman" else both
            want = np.corrcoef(ranked.iloc[:, 0], ranked.iloc[:, 1])[0, 1]
        assert c == pytest.approx(want, abs=1e-9, nan_ok=True), (i, j)


def test_covariance_does_not_cancel_and_risk_parity_leaves_out_whom_it_cannot_weigh(spark):
    rng = np.random.default_rng(3)
    v = pd.DataFrame({"a": 1e6 + rng.normal(size=300), "b": -1e6 + rng.normal(size=300), "c": np.nan})
    v.loc[0, "c"] = 1.0
    long = v.melt(ignore_index=False, var_name="symbol", value_name="ret").reset_index(names="t").dropna().assign(portfolio="p")
    d = spark.createDataFrame(long)
    cov = pf.covariance(d).toPandas().set_index(["sym_i", "sym_j"])["value"]
    assert cov["a", "b"] == pytest.approx(v["a"].cov(v["b"]), rel=1e-9) and cov["a", "a"] == pytest.approx(v["a"].var(), rel=1e-9)
    w = pf.risk_parity_weights(d, 300).toPandas().set_index("symbol")["weight"]
    assert set(w.index) == {"a", "b"} and w.sum() == pytest.approx(1)


@pytest.mark.parametrize("span,limit", [(7, 7), (900, None), (900, 900), (3, None), (1, None)])
def test_exponential_mean_over_many_blocks(spark, monkeypatch, span, limit):
    """Spans as a column, with and without a bound, over a hundred blocks."""
    from tidemark.operators import series

    monkeypatch.setattr(series, "EWM_BLOCK", 8)
    x = walk(801, 3)
    d = with_ordinal(bars_of(spark, x)).withColumn("span", F.lit(span))
    got = ewm_mean(d, "close", F.col("span"), "y", max_span=limit).toPandas().sort_values("bar_idx")["y"]
    want = pd.Series(x).ewm(span=span, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-12)


def repeated_lines(spark, folder):
    """The 0.001 tables, each line item followed by others of its day, order and line number at other prices."""
    for name in ("lineitem", "supplier", "nation", "region"):
        t = pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "lineitem":
            t["l_shipdate"] = t["l_shipdate"].astype("datetime64[us]")
            t = pd.concat([t.assign(l_extendedprice=t["l_extendedprice"] * (1 + x * (np.arange(len(t)) % 5))) for x in (0.0, 0.3, -0.1)])
        t.to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_daily_smoothing_takes_the_first_of_equal_lines(spark, tmp_path):
    import compare, __spark_entry__ as entry

    folder = repeated_lines(spark, tmp_path)
    for name in ("f3_smooth_daily", "a2_daily_bars_by_region"):
        got = entry.queries()[name](spark, folder).toPandas()
        assert compare.differences(got, compare.oracle(folder).execute(entry.oracle_sql()[name]).df()) is None


def test_places_follow_files_and_rows(spark, tmp_path):
    for i, name in enumerate(["b", "a", "c d"]):
        pd.DataFrame({"x": np.arange(3) + 10 * i}).to_parquet(f"{tmp_path}/{name}.parquet")
    rows = tk.with_place(spark.read.parquet(str(tmp_path))).orderBy("place").collect()
    assert [r["x"] for r in rows] == [10, 11, 12, 0, 1, 2, 20, 21, 22]
    day = tk.with_place(spark.read.parquet(str(tmp_path))).selectExpr(
        "'a' AS symbol", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "9223372036854775807L AS seq", "x * 1.0D AS price", "1.0D AS qty", "place")
    bar = tk.ticks_to_bars(day, "1d", "seq", place="place").first()
    assert (bar["open"], bar["close"], bar["low"], bar["high"]) == (10, 10, 0, 22)


def test_alignment_takes_the_first_of_equal_lines(spark, tmp_path):
    import compare, __spark_entry__ as entry

    folder = repeated_lines(spark, tmp_path)
    for name in ("j3_align_intersection", "j3_align_union"):
        got = entry.queries()[name](spark, folder).toPandas()
        assert len(got) and compare.differences(got, compare.oracle(folder).execute(entry.oracle_sql()[name]).df()) is None


ODD_LINES = {
    "hours": lambda t, i: t.assign(l_shipdate=t["l_shipdate"] + pd.to_timedelta((t["l_orderkey"] * 7919 + 13 * i) % 24, unit="h")),
    "numbers": lambda t, i: t.assign(l_orderkey=t["l_orderkey"] % 40, l_linenumber=((t["l_linenumber"] * 7919 + 31 * i) % 900).astype("int32")),
    "unpriced": lambda t, i: t.assign(l_extendedprice=t["l_extendedprice"].where((np.arange(len(t)) + i) % 3 > 0)),
}


@pytest.mark.parametrize("odd", ODD_LINES)
def test_alignment_takes_the_last_line_as_sql_does(spark, tmp_path, odd):
    """Dates with hours, more than seven lines in an order, lines without a price."""
    import compare, __spark_entry__ as entry

    folder = repeated_lines(spark, tmp_path)
    t = pd.read_parquet(f"{folder}/lineitem.parquet")
    t = pd.concat([ODD_LINES[odd](t, i) for i in range(2)])
    t["l_shipdate"] = t["l_shipdate"].astype("datetime64[us]")
    t.to_parquet(f"{folder}/lineitem.parquet")
    for name in ("j3_align_intersection", "j3_align_union"):
        got = entry.queries()[name](spark, folder).toPandas()
        assert len(got) and compare.differences(got, compare.oracle(folder).execute(entry.oracle_sql()[name]).df()) is None
