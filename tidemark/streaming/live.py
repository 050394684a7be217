"""Live bars with Structured Streaming: tumbling bars, upserts, update log, signal refresh."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.series import with_ordinal
from tidemark.plans.staging import stage
from tidemark.plans.strategy import Trend, trend_signals
from tidemark.schema import BAR_COLUMNS, SERIES
from tidemark.sources.store import ROW_KEY, VERSION, merge_bars, month_of, newest_per_bar, read_bars, scan, stored_partitions
from tidemark.sources.ticks import ticks_to_bars

#: What a stream has at its start is worked off, then it ends; pass processingTime to keep it running.
ONCE = {"availableNow": True}


def stream_bars(ticks: DataFrame, interval: str, lateness: str = "10 minutes", sequence: str = "ts") -> DataFrame:
    """Tumbling OHLCV bars of a tick stream, emitted once the watermark passes their end.

    Watermarks need zoned timestamps; run with the session time zone set to UTC.
    """
    zoned = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    bars = ticks_to_bars(zoned, interval, sequence)
    return bars.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("open_time", "close_time")})


def upsert_stream(
    bars: DataFrame, path: str, checkpoint: str, final_only: bool = False, start: str | None = None,
    version: str = "seq", trigger: dict | None = None,
) -> StreamingQuery:
    """Merge a stream of bar rows into the bar store, the newest ``version`` of each bar winning.

    The version is stored, so an older row that comes in a later batch changes nothing. Replaying a micro-batch after a failure merges the same rows again, which changes nothing.
    """
    if final_only:
        bars = bars.where(F.col("is_final"))
    if start is not None:
        bars = bars.where(F.col("open_time") >= F.lit(start).cast("timestamp_ntz"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*SERIES, *BAR_COLUMNS, F.col(version).cast("bigint").alias(VERSION), F.col(version).alias("_newest"))
        rows = newest_per_bar(rows, "_newest")
        merge_bars(batch.sparkSession, path, rows, f"{checkpoint}-merge/{batch_id}")

    return (
        bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()
    )


def store_stream_bars(
    ticks: DataFrame, path: str, checkpoint: str, interval: str, lateness: str = "10 minutes", sequence: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Bars of a tick stream merged into the bar store as they grow, the open ones included.

    Every micro-batch emits the bars it changed, so nothing waits for the watermark.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_bars(batch.sparkSession, path, stage(batch), f"{checkpoint}-merge/{batch_id}")

    bars = stream_bars(ticks, interval, lateness, sequence)
    return (
        bars.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE)).start()
    )


def update_log(bars: DataFrame, path: str, checkpoint: str, source: str = "ws", trigger: dict | None = None) -> StreamingQuery:
    """Append one update row per message: (series, open_time, close_time, is_final, source)."""
    rows = bars.select(*SERIES, "open_time", "close_time", "is_final", F.lit(source).alias("source"))
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or ONCE)).start()
    )


def backfill_updates(before: DataFrame, after: DataFrame) -> DataFrame:
    """A ``rest`` update for every series whose last bar differs after a backfill."""
    row = F.struct(*[c for c in BAR_COLUMNS])
    old = before.groupBy(*SERIES).agg(F.max_by(row, "open_time").alias("_old"))
    new = after.groupBy(*SERIES).agg(F.max_by(row, "open_time").alias("_new"))
    changed = new.join(old, SERIES, "left").where(~F.col("_new").eqNullSafe(F.col("_old")))
    return changed.select(
        *SERIES, "_new.open_time", "_new.close_time", F.lit(True).alias("is_final"), F.lit("rest").alias("source")
    )


def merge_backfill(spark: SparkSession, path: str, snapshot: DataFrame, staging: str) -> DataFrame:
    """Merge a snapshot of bars into the store; returns the ``rest`` updates of series whose last bar changed.

    One run of a periodic job: the snapshot is what was fetched again, the store what the stream wrote.
    """
    before = stored_partitions(spark, path, snapshot)
    before = snapshot.limit(0) if before is None else stage(before)
    merge_bars(spark, path, snapshot, staging)
    return backfill_updates(before, stored_partitions(spark, path, snapshot))


def refresh_decision(updates: DataFrame, force_full: bool = False, series: DataFrame | None = None) -> DataFrame:
    """Per series: ``full`` after a final or backfilled bar (or when forced), else ``tail``.

    With ``series``, all that are followed, those without an update are told as ``cached``, or ``full``
    when forced.
    """
    full = F.bool_or(F.col("is_final") | (F.col("source") == "rest")) | F.lit(force_full)
    decided = updates.groupBy(*SERIES).agg(F.when(full, "full").otherwise("tail").alias("refresh"))
    if series is None:
        return decided
    idle = F.lit("full" if force_full else "cached")
    return series.select(*SERIES).distinct().join(decided, SERIES, "left").withColumn("refresh", F.coalesce("refresh", idle))


def context_bars(rule: Trend, window: int | None = None) -> int:
    """How many trailing bars a tail refresh recomputes."""
    needed = max(2 * rule.min_trend_bars, 3 * rule.atr_period, 3 * rule.window, 4 * (rule.slope_lookback + 1), 256)
    return max(64, window or needed)


_RESULT = ["smoothed", "long_stop", "long_profit", "signal"]


def full_refresh(bars: DataFrame, rule: Trend) -> DataFrame:
    return trend_signals(bars, rule).select(*SERIES, "open_time", "bar_idx", *_RESULT)


def tail_refresh(previous: DataFrame, bars: DataFrame, rule: Trend, window: int | None = None) -> DataFrame:
    """Recompute only the last bars of each series from those bars alone; keep the rest."""
    indexed = bars if "bar_idx" in bars.columns else with_ordinal(bars)
    w = F.lit(context_bars(rule, window))
    start = F.greatest(F.lit(0), F.col("n_bars") - w)
    tail = indexed.where(F.col("bar_idx") >= start).withColumn("_start", start)
    tail = tail.withColumn("bar_idx", F.col("bar_idx") - start).withColumn("n_bars", F.least("n_bars", w))
    fresh = trend_signals(tail, rule)
    fresh = fresh.withColumn("bar_idx", F.col("bar_idx") + F.col("_start")).select(*SERIES, "open_time", "bar_idx", *_RESULT)
    keep = previous.join(fresh.select(*SERIES, "open_time"), [*SERIES, "open_time"], "left_anti")
    return keep.unionByName(fresh)


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The rows of ``_write_whole``, or None when they were never written to the end."""
    try:
        rows = spark.read.schema(schema.add("_total", "long")).parquet(path)
    except AnalysisException:
        return None
    n, total = rows.agg(F.count("*"), F.max("_total")).first()
    return rows.drop("_total") if n and n == total else None


def _write_whole(rows: DataFrame, path: str) -> DataFrame:
    """Write the rows together with their number, which tells a whole table from a broken one."""
    rows = stage(rows)
    schema = T.StructType(list(rows.schema.fields))
    rows.withColumn("_total", F.lit(rows.count())).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def month_counts(spark: SparkSession, path: str, series: DataFrame) -> DataFrame:
    """(symbol, interval, month, n, before, n_bars) of the stored months of ``series``; no column is read for it."""
    ordered = Window.partitionBy(*SERIES).orderBy("month")
    counts = scan(spark, path).join(series.select(*SERIES), SERIES, "left_semi").groupBy(*SERIES, "month").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({
        "before": F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n_bars": F.sum("n").over(Window.partitionBy(*SERIES)),
    })


def last_bars(spark: SparkSession, path: str, series: DataFrame, most: int) -> DataFrame:
    """The last ``most`` bars of each of ``series`` with their ``bar_idx`` and ``n_bars``, from the months that hold them."""
    counts = stage(month_counts(spark, path, series))
    wanted = counts.where(F.col("before") + F.col("n") > F.col("n_bars") - most)
    months = [r[0] for r in wanted.select("month").distinct().collect()]
    start = wanted.groupBy(*SERIES).agg(F.min("before").alias("_before"))
    rows = scan(spark, path).where(F.col("month").isin(months)).join(wanted.select(*SERIES, "month"), [*SERIES, "month"], "left_semi")
    numbered = with_ordinal(rows.select(*SERIES, *BAR_COLUMNS)).join(start, SERIES)
    numbered = numbered.withColumns({"bar_idx": F.col("bar_idx") + F.col("_before"), "n_bars": F.col("n_bars") + F.col("_before")}).drop("_before")
    return numbered.where(F.col("bar_idx") >= F.col("n_bars") - most)


@dataclass(frozen=True)
class LiveRefresh:
    """What ``refresh_stream`` does with a micro-batch, in steps that can be taken again after a failure.

    ``decide`` writes what arrived and, for every series of it, how it is to be computed, before anything is
    changed; a batch that is replayed finds that decision. ``merge`` puts the bars into the store, ``compute`` writes
    the new signals aside, and ``publish`` replaces the months of the results that they belong to. Each step that was
    finished is read, not taken again, so a replay gives what an undisturbed run gives.
    """

    path: str
    results: str
    checkpoint: str
    rule: Trend = Trend()
    window: int | None = None
    version: str = "seq"

    @property
    def reach(self) -> int:
        return context_bars(self.rule, self.window)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        arrived, decided = self.decide(batch, batch_id)
        self.merge(arrived, batch_id)
        self.publish(self.compute(decided, batch_id), arrived, batch_id)

    def decide(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(the newest row of each bar, (symbol, interval, refresh)); from the log if the batch was decided before."""
        spark = batch.sparkSession
        rows = batch.select(*SERIES, *BAR_COLUMNS, "is_final", F.col(self.version).cast("bigint").alias(VERSION), F.col(self.version).alias("_newest"))
        arrived = stage(newest_per_bar(rows, "_newest"))
        log = f"{self.checkpoint}-decisions/{batch_id}"
        told = _written(spark, log, T.StructType([*arrived.select(*SERIES).schema.fields, T.StructField("refresh", T.StringType())]))
        if told is not None:
            return arrived, told
        before = stored_partitions(spark, self.path, arrived)
        if before is None:
            fresh = arrived.withColumn("_new", F.lit(True))
        else:
            fresh = arrived.join(before.select(*ROW_KEY, F.lit(False).alias("_new")), ROW_KEY, "left").withColumn("_new", F.coalesce("_new", F.lit(True)))
        whole = F.col("is_final") | F.col("_new")
        decided = stage(refresh_decision(fresh.withColumn("is_final", whole).withColumn("source", F.lit("ws"))))
        if before is not None:
            # a tail refresh would keep the old signal of a bar before its reach
            partial = decided.where("refresh = 'tail'")
            reached = last_bars(spark, self.path, partial, self.reach).select(*ROW_KEY)
            early = arrived.join(partial.select(*SERIES), SERIES, "left_semi").join(reached, ROW_KEY, "left_anti")
            decided = decided.join(early.select(*SERIES, F.lit("full").alias("_early")).distinct(), SERIES, "left").select(
                *SERIES, F.coalesce("_early", "refresh").alias("refresh"))
        return arrived, _write_whole(decided, log)

    def merge(self, arrived: DataFrame, batch_id: int) -> None:
        merge_bars(arrived.sparkSession, self.path, arrived, f"{self.checkpoint}-merge/{batch_id}")

    def compute(self, decided: DataFrame, batch_id: int) -> DataFrame | None:
        """The signals that change, by series and month; None without any series."""
        spark = decided.sparkSession
        aside = f"{self.checkpoint}-signals/{batch_id}"
        bars = read_bars(spark, self.path)
        if bars is None:
            return None
        fresh = full_refresh(bars.join(decided.where("refresh = 'full'"), SERIES, "left_semi"), self.rule)
        shape = T.StructType([*fresh.schema.fields, T.StructField("month", T.StringType())])
        told = _written(spark, aside, T.StructType(list(shape.fields)))
        if told is not None:
            return told
        known = self._known(spark, shape)
        if known is not None:
            tail = stage(last_bars(spark, self.path, decided.where("refresh = 'tail'"), self.reach))
            months = tail.select(*SERIES, month_of("open_time").alias("month")).distinct()
            kept = known.join(months, [*SERIES, "month"], "left_semi").drop("month")
            fresh = fresh.unionByName(tail_refresh(kept, tail, self.rule, self.window))
        return _write_whole(fresh.withColumn("month", month_of("open_time")), aside)

    def _known(self, spark: SparkSession, shape: T.StructType) -> DataFrame | None:
        try:
            return spark.read.schema(shape).parquet(self.results)
        except AnalysisException:  # nothing has been computed yet
            return None

    def publish(self, signals: DataFrame | None, arrived: DataFrame, batch_id: int) -> None:
        if signals is None:
            return
        parts = [*SERIES, "month"]
        signals.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(self.results)
        touched = signals.drop("month").join(arrived.select(*ROW_KEY), ROW_KEY, "left_semi")
        touched.write.mode("overwrite").parquet(f"{self.results}-touched/batch={batch_id}")


def refresh_stream(
    bars: DataFrame, path: str, results: str, checkpoint: str, rule: Trend = Trend(), window: int | None = None,
    version: str = "seq", trigger: dict | None = None,
) -> StreamingQuery:
    """Merge a stream of bar rows into the store and keep the signals of every series up to date.

    A series that receives a final or a new bar, or a partial update of a bar before those that a tail refresh
    computes, is computed anew from all its stored bars; one with other partial updates only from its last bars, and
    only the months that hold them are read and written; others are left as they are. ``results`` holds the signals of
    all bars by (symbol, interval, month); ``<results>-touched`` holds for every micro-batch the signal of each bar
    that arrived in it, however many. A micro-batch that dies at any point and is replayed gives the same rows as
    one that did not (``LiveRefresh``); decisions and signals of past batches, under ``<checkpoint>-decisions`` and
    ``<checkpoint>-signals``, can be cleared once the next batch has begun.
    """
    refresh = LiveRefresh(path, results, checkpoint, rule, window, version)
    return bars.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
