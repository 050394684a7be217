"""Result tables written as CSV, Parquet and JSON folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.montecarlo import metric_distribution, summarise
from tidemark.operators.search import best_result
from tidemark.plans.optimise import METRICS, WalkForward
from tidemark.schema import SERIES


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_leaderboard(board: DataFrame, path: str, fmt: str = "csv") -> None:
    """``csv`` or ``parquet``."""
    if fmt == "csv":
        write_csv(board, path)
    elif fmt == "parquet":
        board.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def best_config(results: DataFrame, params: list[str], method: str, metric: str, seed: int | None, keys: list[str] = SERIES) -> DataFrame:
    """One JSON document per series describing its best candidate."""
    doc = F.struct(
        F.lit(method).alias("method"), F.lit(metric).alias("objective_metric"),
        F.col(metric).alias("best_score"), F.lit(seed).cast("long").alias("seed"),
        F.struct(*params).alias("best_params"),
    )
    return best_result(results, metric, keys).select(*keys, F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def write_best_config(results: DataFrame, path: str, params: list[str], method: str, metric: str, seed: int | None, keys: list[str] = SERIES) -> None:
    docs = best_config(results, params, method, metric, seed, keys)
    docs.write.mode("overwrite").partitionBy(*keys).text(path)


def write_walk_forward(run: WalkForward, path: str) -> None:
    write_csv(run.windows, f"{path}/windows")
    write_csv(run.train, f"{path}/train_metrics")
    write_csv(run.test.select(*SERIES, "window_id", *METRICS), f"{path}/test_metrics")
    write_csv(run.best, f"{path}/best_params_per_window")
    run.out_of_sample.write.mode("overwrite").json(f"{path}/combined_oos_metrics")


def write_monte_carlo(per_sim: DataFrame, path: str, keys: list[str] = SERIES) -> None:
    summarise(per_sim, keys).write.mode("overwrite").json(f"{path}/summary")
    long = metric_distribution(per_sim, keys)
    long.write.mode("overwrite").partitionBy("metric").option("header", True).csv(f"{path}/distribution")


def write_trades(trades: DataFrame, path: str) -> None:
    """Trade log as CSV; the partial exits travel as JSON text."""
    write_csv(trades.withColumn("partial_exits", F.to_json("partial_exits")), path)


def write_search(results: DataFrame, board: DataFrame, path: str, params: list[str], method: str, metric: str, seed: int | None, keys: list[str] = SERIES) -> None:
    write_leaderboard(board, f"{path}/leaderboard_csv", "csv")
    write_leaderboard(board, f"{path}/leaderboard_parquet", "parquet")
    write_best_config(results, f"{path}/best_config", params, method, metric, seed, keys)
