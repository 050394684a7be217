"""The bar store: a Parquet table partitioned by (symbol, interval, month).

The month bounds what an upsert has to rewrite and splits the files of a long series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.series import drop_halo, chunk_window, lay_out, with_ordinal
from tidemark.plans.staging import fresh_folder
from tidemark.schema import BAR_COLUMNS, BAR_SCHEMA, HISTORY_START, MILLISECOND, SERIES, duration, interval_length
from tidemark.sources.ticks import ticks_to_bars

ROW_KEY = [*SERIES, "open_time"]
PARTITION = [*SERIES, "month"]
#: Optional column of the table: the version of a bar that was stored.
VERSION = "version"


def month_of(time: str) -> Column:
    return F.date_format(time, "yyyy-MM")


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", month_of("open_time"))


def scan(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its version and month, or None when it does not exist or cannot be read."""
    try:
        return spark.read.schema(f"{BAR_SCHEMA}, {VERSION} bigint, month string").parquet(path)
    except Exception as problem:  # AnalysisException: path missing or unreadable
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER" in str(problem):
            return None
        raise


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame | None:
    """The stored bars, all or those with ``start <= open_time <= end``; None without a table.

    A range reads only the months it covers.
    """
    bars = scan(spark, path)
    if bars is None:
        return None
    for bound, inside in ((start, lambda m: F.col("month") >= m), (end, lambda m: F.col("month") <= m)):
        if bound is not None:
            bars = bars.where(inside(F.date_format(F.lit(bound).cast("timestamp_ntz"), "yyyy-MM")))
    return in_range(bars, start, end).select(*SERIES, *BAR_COLUMNS)


def load_range(
    spark: SparkSession, path: str, interval: str, start: str, end: str, ticks: DataFrame | None = None,
    force_refresh: bool = False, sequence: str = "ts",
) -> DataFrame:
    """Bars of one interval in a range, from the store; ``force_refresh`` builds them from ``ticks`` anew
    and merges them into the store first."""
    duration(interval)
    if force_refresh:
        if ticks is None:
            raise ValueError("force_refresh needs ticks to build bars from")
        merge_bars(spark, path, in_range(ticks_to_bars(ticks, interval, sequence), start, end), fresh_folder(spark, "merge"))
    found = read_bars(spark, path, start, end)
    if found is None:
        raise ValueError(f"no bars stored at {path}")
    return found.where(F.col("interval") == interval)


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with ``start <= open_time <= end``; reaches the Parquet scan as a pushed filter."""
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be earlier than end")
    if start is not None:
        bars = bars.where(F.col("open_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("open_time") <= F.lit(end).cast("timestamp_ntz"))
    return bars


def newest_per_bar(bars: DataFrame, version: str) -> DataFrame:
    """One row per bar key: the one with the highest ``version``.

    An aggregate rather than a window: many copies of one bar are combined before the shuffle.
    """
    payload = [c for c in bars.columns if c not in (*ROW_KEY, version)]
    kept = bars.groupBy(*ROW_KEY).agg(F.max_by(F.struct(*payload), version).alias("_row"))
    return kept.select(*ROW_KEY, *[F.col(f"_row.{c}").alias(c) for c in payload])


def upsert(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Union of both. Where both have the bar and a version, the newer version wins, the arriving row on a
    tie; otherwise the arriving row wins."""
    def ranked(df: DataFrame, rank: int, without: int) -> DataFrame:
        version = F.col(VERSION) if VERSION in df.columns else F.lit(None).cast("bigint")
        return df.withColumn("_rank", F.struct(F.coalesce(version, F.lit(without)).alias("version"), F.lit(rank).alias("side")))

    return newest_per_bar(ranked(stored, 0, -(2**63)).unionByName(ranked(arrived, 1, 2**63 - 1), allowMissingColumns=True), "_rank")


def write_bars(bars: DataFrame, path: str, version: str | None = None) -> None:
    """Replace the (symbol, interval, month) partitions present in ``bars``; no rows replace nothing."""
    rows = newest_per_bar(bars, version) if version else bars
    (
        _with_month(rows.select(*SERIES, *BAR_COLUMNS, *([VERSION] if VERSION in rows.columns else [])))
        .repartition(*PARTITION)
        .sortWithinPartitions(*PARTITION, "open_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION)
        .parquet(path)
    )


def stored_partitions(spark: SparkSession, path: str, arrived: DataFrame) -> DataFrame | None:
    """The stored rows of the partitions that ``arrived`` touches; other months are not scanned.

    The months are listed on the driver: a history has at most some hundreds.
    """
    stored = scan(spark, path)
    if stored is None:
        return None
    partitions = _with_month(arrived.select(*ROW_KEY)).select(*PARTITION).distinct()
    months = [r[0] for r in partitions.select("month").distinct().collect()]
    return stored.where(F.col("month").isin(months)).join(partitions, PARTITION, "left_semi").drop("month")


def merge_bars(spark: SparkSession, path: str, arrived: DataFrame, staging: str) -> None:
    """Upsert into the store, touching only the partitions that receive rows.

    A ``version`` column of ``arrived`` is stored, so a late older version never replaces a newer one.
    Spark cannot overwrite files it is reading, so the merged rows pass through ``staging``.
    """
    arrived = arrived.select(*SERIES, *BAR_COLUMNS, *([VERSION] if VERSION in arrived.columns else []))
    touched = stored_partitions(spark, path, arrived)
    if touched is None:
        rank = F.coalesce(F.col(VERSION), F.lit(-(2**63))) if VERSION in arrived.columns else F.lit(1)
        write_bars(newest_per_bar(arrived.withColumn("_rank", rank), "_rank"), path)
        return
    write_bars(upsert(touched, arrived), staging)
    fresh = scan(spark, staging)
    if fresh is not None:
        write_bars(fresh.drop("month"), path)


def series_span(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(
        F.min("open_time").alias("first_open"), F.max("close_time").alias("last_close")
    )


def find_gaps(bars: DataFrame, interval: str, slack_seconds: int = 1) -> DataFrame:
    """Holes between consecutive bars: opens more than interval + 1 s apart."""
    laid = lay_out(with_ordinal(bars.select(*ROW_KEY, "close_time")), ahead=1)
    following = F.lead("open_time").over(chunk_window())
    limit = F.col("open_time") + interval_length(interval) + F.expr(f"INTERVAL '{slack_seconds}' SECOND")
    return (
        drop_halo(laid.withColumn("gap_end", following))
        .where(F.col("gap_end") > limit)
        .select(*SERIES, F.col("close_time").alias("gap_start"), "gap_end")
    )


def missing_ranges(bars: DataFrame, interval: str, start: str, end: str) -> DataFrame:
    """What must be fetched so every series covers [start, end]: head, tail and inner gaps."""
    if start >= end:
        raise ValueError("start must be earlier than end")
    lo, hi = (F.lit(v).cast("timestamp_ntz") for v in (start, end))
    after = F.expr(MILLISECOND)
    span = series_span(bars)
    head = span.where(F.col("first_open") > lo).select(
        *SERIES, F.lit("head").alias("kind"), lo.alias("range_start"), F.col("first_open").alias("range_end")
    )
    tail = span.where(F.col("last_close") < hi).select(
        *SERIES, F.lit("tail").alias("kind"), (F.col("last_close") + after).alias("range_start"), hi.alias("range_end")
    )
    inner = find_gaps(bars, interval).select(
        *SERIES, F.lit("gap").alias("kind"), (F.col("gap_start") + after).alias("range_start"),
        F.col("gap_end").alias("range_end"),
    )
    return head.unionByName(tail).unionByName(inner)


def update_start(bars: DataFrame) -> DataFrame:
    """Where the next incremental load of each series begins."""
    return series_span(bars).select(
        *SERIES,
        F.coalesce(
            F.col("last_close") + F.expr(MILLISECOND), F.lit(HISTORY_START).cast("timestamp_ntz")
        ).alias("update_from"),
    )


def backfill(bars: DataFrame, ranges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add the candidate bars that fall into missing ranges and are not stored yet.

    The range match is an equi-join on (series, month): a range is split into the months it covers.
    """
    def month(c: str | Column) -> Column:
        return F.year(c) * 12 + F.month(c)

    spans = ranges.withColumn("_m", F.explode(F.sequence(month("range_start"), month("range_end"))))
    wanted = (
        candidates.withColumn("_m", month("open_time"))
        .join(spans.select(*SERIES, "_m", "range_start", "range_end"), [*SERIES, "_m"])
        .where(F.col("open_time").between(F.col("range_start"), F.col("range_end")))
        .drop("_m", "range_start", "range_end")
        .dropDuplicates(ROW_KEY)
    )
    return bars.unionByName(wanted.join(bars.select(*ROW_KEY), ROW_KEY, "left_anti"))


def data_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min("open_time"), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max("open_time"), "yyyy-MM-dd").alias("last_date"),
        F.avg("volume").alias("avg_volume"),
        F.min("low").alias("min_low"),
        F.max("high").alias("max_high"),
    )
