"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import base, optimise, portfolios, signals  # noqa: E402
from catalog.backtests import FLAGSHIP  # noqa: E402
from tidemark.operators import align, montecarlo as mc, search as so, spectral as sp  # noqa: E402
from tidemark.operators.series import with_ordinal  # noqa: E402
from tidemark.plans import optimise as op  # noqa: E402
from tidemark.plans.portfolio_run import run_portfolio  # noqa: E402
from tidemark.plans.staging import fresh_folder  # noqa: E402
from tidemark.plans.strategy import add_atr, add_smoothed, run_trend  # noqa: E402
from tidemark.sources import store  # noqa: E402
from tidemark.sources.ticks import resample_bars  # noqa: E402

SPACE = {
    "min_trend_period_hours": so.Axis("float", 12.0, 48.0), "cutoff_scale": so.Axis("float", 0.5, 2.0),
    "atr_period": so.Axis("int", 7, 28), "k_stop": so.Axis("float", 1.0, 4.0),
    "slope_threshold": so.Axis("float", 0.0, 0.001), "slope_lookback": so.Axis("int", 1, 3),
}


def asof(spark, sf):
    fine = base.bars(spark, sf, "30m")
    high = resample_bars(fine, "4h").select("symbol", "open_time", "close", "trades")
    return align.asof_join(fine.select("symbol", "open_time", "close"), high, "4h")


def merge(spark, sf):
    """The second half of the hourly bars merged into a store that holds all of them."""
    d, path = base.bars(spark, sf), fresh_folder(spark, "store")
    store.write_bars(d, path)
    store.merge_bars(spark, path, d.where("open_time >= timestamp_ntz'2024-01-16 00:00:00'"), path + "-merge")
    return store.read_bars(spark, path)


QUERIES = {
    "a2_bars_from_ticks": lambda s, d: base.bars(s, d),
    "a2_daily_bars_1000_series": lambda s, d: base.daily_bars(s, d, "supplier"),
    "j1_asof_join": asof,
    "f3_smooth_1000_series": lambda s, d: add_smoothed(base.daily_bars(s, d, "supplier"), FLAGSHIP),
    "a5_store_merge": merge,
    "f6_welch_64": lambda s, d: sp.welch_psd(base.indexed(s, d), window=64),
    "f6_welch_256": lambda s, d: sp.welch_psd(base.indexed(s, d)),
    "f7_sliding_period_512_75": lambda s, d: sp.sliding_dominant_period(with_ordinal(base.daily_bars(s, d)), window=512, overlap=0.75),
    "r2_atr": lambda s, d: add_atr(base.bars(s, d), 14),
    "e2_backtest_hourly": lambda s, d: run_trend(base.bars(s, d), FLAGSHIP)[2],
    "e2_backtest_1000_series": lambda s, d: run_trend(base.daily_bars(s, d, "supplier"), FLAGSHIP)[2],
    "o5_grid_64": lambda s, d: op.search(op.prepare(base.bars(s, d)), op.Search(SPACE, "grid", points=2)),
    "o11_walk_forward": lambda s, d: optimise.walk(s, d).out_of_sample,
    "m4_monte_carlo_1000": lambda s, d: mc.summarise(mc.bootstrap_metrics(optimise.damped_returns(s, d), 10000.0, n_sims=1000, seed=5)),
    "p10_portfolio": lambda s, d: run_portfolio(portfolios.member_returns(s, d), portfolios.POLICY).metrics,
    "s8_timeframe_vote": lambda s, d: signals.mtf(s, d),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs several JVM calls per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    # start the JVM's compilers and the Python workers before the clock runs
    sink(add_smoothed(base.bars(spark, sf_dir), FLAGSHIP).withColumn("n", F.lit(1)))
    took = {}
    for name, run in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.perf_counter()
        sink(run(spark, sf_dir))
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
