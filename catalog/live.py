"""Streaming operators (T1-T8), replayed from files and compared with batch SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog.base import HOURLY, SMOOTHED, TICKS, bars, bars_sql, query, r, rounded, rs, signals_sql, smooth_sql, table, ticks, with_
from catalog.backtests import FLAGSHIP
from tidemark.operators.series import with_ordinal
from tidemark.plans.staging import fresh_folder, stage
from tidemark.schema import BAR_COLUMNS, SERIES
from tidemark.sources import store
from tidemark.streaming import live, payloads


def in_files(df, parts: int):
    """Write ``df`` in ``parts`` appends of increasing ``_turn``, so a file stream replays it in order."""
    path = fresh_folder(df.sparkSession, "stream") + "/in"
    cut = df.withColumn("_p", F.floor(F.col("_turn") * parts)).drop("_turn")
    cut = stage(cut)
    for i in range(parts):
        cut.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("append").parquet(path)
    return path


RAW = """raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '{"e": 1}'
  WHEN 2 THEN '{"k": {"t": ' || (1700000000000 + event_id) || ', "o": "1.5"}}'
  WHEN 3 THEN '{"k": {"t": 1, "T": 2, "o": "abc", "h": "2", "l": "1", "c": "1", "v": "3", "q": "4", "n": 5}}'
  ELSE '{"k": {"t": ' || (1700000000000 + event_id * 1000) || ', "T": ' || (1700000000999 + event_id * 1000) || ', "o": "' || user_id || '.5", "h": "9", "l": "1", "c": "2.25", "v": "3", "q": "4", "n": ' || user_id || ', "x": ' || (user_id % 2 = 0) || '}}'
  END AS value FROM events)"""


@query("t1_payload_parse", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN make_timestamp((1700000000000 + event_id * 1000) * 1000) WHEN 3 THEN make_timestamp(1000) ELSE make_timestamp((1700000000000 + event_id) * 1000) END AS open_time,
  CASE event_id % 5 WHEN 4 THEN user_id + 0.5 WHEN 3 THEN NULL ELSE 1.5 END::DOUBLE AS open, CASE event_id % 5 WHEN 4 THEN user_id WHEN 3 THEN 5 END AS trades,
  event_id % 5 = 4 AND user_id % 2 = 0 AS is_final, CASE event_id % 5 WHEN 2 THEN 'payload lacks T, c, h, l, n, q, v' WHEN 3 THEN 'payload cannot be read' END AS error
  FROM events WHERE event_id % 5 >= 2""")
def t1(spark, sf):
    e = table(spark, sf, "events")
    lit, text = F.lit, lambda c: c.cast("string")
    ms = lit(1700000000000) + F.col("event_id") * 1000
    good = F.concat(
        lit('{"k": {"t": '), text(ms), lit(', "T": '), text(ms + 999), lit(', "o": "'), text(F.col("user_id")),
        lit('.5", "h": "9", "l": "1", "c": "2.25", "v": "3", "q": "4", "n": '), text(F.col("user_id")), lit(', "x": '),
        text(F.col("user_id") % 2 == 0), lit("}}"),
    )
    kind = F.col("event_id") % 5
    value = (
        F.when(kind == 0, "not json").when(kind == 1, '{"e": 1}')
        .when(kind == 2, F.concat(lit('{"k": {"t": '), text(lit(1700000000000) + F.col("event_id")), lit(', "o": "1.5"}}')))
        .when(kind == 3, '{"k": {"t": 1, "T": 2, "o": "abc", "h": "2", "l": "1", "c": "1", "v": "3", "q": "4", "n": 5}}')
        .otherwise(good)
    )
    parsed = payloads.parse_payloads(e.select("event_id", value.alias("value")))
    return parsed.select("event_id", "open_time", "open", "trades", "is_final", "error")


def messages(spark, sf):
    """Two versions of every hourly bar: a partial one closing at its open, then the final one.

    The last bar of each series never becomes final.
    """
    d = with_ordinal(bars(spark, sf))
    last = F.col("bar_idx") == F.col("n_bars") - 1
    versions = F.when(last, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    m = d.withColumn("is_final", F.explode(versions))
    m = m.withColumn("close", F.when(F.col("is_final"), F.col("close")).otherwise(F.col("open")))
    m = m.withColumn("seq", F.col("bar_idx") * 2 + F.col("is_final").cast("long"))
    return m.withColumn("_turn", F.col("bar_idx") / F.col("n_bars")).select(*SERIES, *BAR_COLUMNS, "is_final", "seq", "_turn")


def message_stream(spark, sf, parts=3):
    path = in_files(messages(spark, sf), parts)
    return live.read_stream(spark, path, spark.read.parquet(path).schema)


def _merged(spark, sf, final_only):
    out = fresh_folder(spark, "stream")
    live.upsert_stream(message_stream(spark, sf), f"{out}/bars", f"{out}/ckpt", final_only, start="2024-01-03 00:00:00").awaitTermination()
    return store.read_bars(spark, f"{out}/bars").select("symbol", "open_time", "close", "trades")


LIVE = f"{HOURLY}, lv AS (SELECT *, bar_idx = n_bars - 1 AS open_bar FROM ib)"


@query("t2_keyed_upsert", with_(LIVE, f"SELECT symbol, open_time, {r('CASE WHEN open_bar THEN open ELSE close END', 'close')}, trades FROM lv WHERE open_time >= TIMESTAMP '2024-01-03'"))
def t2(spark, sf):
    return rounded(_merged(spark, sf, False))


@query("t3_final_only_sink", with_(LIVE, f"SELECT symbol, open_time, {rs('close')}, trades FROM lv WHERE NOT open_bar AND open_time >= TIMESTAMP '2024-01-03'"))
def t3(spark, sf):
    return rounded(_merged(spark, sf, True))


@query("t4_update_log", with_(LIVE, """SELECT symbol, open_time, close_time, false AS is_final, 'ws' AS source FROM lv
  UNION ALL SELECT symbol, open_time, close_time, true, 'ws' FROM lv WHERE NOT open_bar"""))
def t4(spark, sf):
    out = fresh_folder(spark, "stream")
    live.update_log(message_stream(spark, sf), f"{out}/log", f"{out}/ckpt").awaitTermination()
    return spark.read.parquet(f"{out}/log").drop("interval")


# Backfill reached only the series whose name has an 'i'.
@query("t5_backfill_update", with_(LIVE, "SELECT symbol, open_time, close_time, true AS is_final, 'rest' AS source FROM lv WHERE open_bar AND symbol LIKE '%i%'"))
def t5(spark, sf):
    d = stage(with_ordinal(bars(spark, sf)))
    partial = d.withColumn("close", F.when(F.col("bar_idx") == F.col("n_bars") - 1, F.col("close") + 1).otherwise(F.col("close")))
    after = d.where("symbol like '%i%'").unionByName(partial.where("symbol not like '%i%'"))
    return live.backfill_updates(partial, after).drop("interval")


TAIL = f"""{SMOOTHED}, {signals_sql()}, tb AS (SELECT symbol, "interval", open_time, open, high, low, close, bar_idx - greatest(n_bars - 256, 0) AS bar_idx,
    least(n_bars, 256) AS n_bars, greatest(n_bars - 256, 0) AS shift FROM ib WHERE bar_idx >= n_bars - 256),
  {smooth_sql(source='tb', name='ts')}, {signals_sql(source='ts', name='tg')}"""


@query("t6_tail_recompute", with_(TAIL, f"""SELECT symbol, bar_idx, {rs('smoothed')}, signal FROM sig WHERE bar_idx < n_bars - 256
  UNION ALL SELECT symbol, bar_idx + shift, {rs('smoothed')}, signal FROM tg"""))
def t6(spark, sf):
    d = stage(with_ordinal(bars(spark, sf)))
    out = live.tail_refresh(stage(live.full_refresh(d, FLAGSHIP)), d, FLAGSHIP)
    return rounded(out.select("symbol", "bar_idx", "smoothed", "signal"))


# Two micro-batches of more than 256 bars a series: each bar's signal from all bars up to its own batch.
BATCHED = f"""{HOURLY}, tb AS (SELECT symbol, b.batch, "interval", open_time, open, high, low, close, bar_idx,
    count(*) OVER (PARTITION BY symbol, b.batch) AS n_bars, CAST(floor(bar_idx::DOUBLE / n_bars * 2) AS BIGINT) AS own FROM ib
    JOIN (SELECT unnest(range(2)) AS batch) b ON CAST(floor(bar_idx::DOUBLE / n_bars * 2) AS BIGINT) <= b.batch),
  {smooth_sql(source='tb', name='ts', keys='symbol, batch')}, {signals_sql(source='ts', name='tg', keys='symbol, batch')}"""


@query("t6_stateful_tail_signals", with_(BATCHED, f"SELECT batch, symbol, open_time, {rs('smoothed')}, signal FROM tg WHERE own = batch"))
def t6_state(spark, sf):
    """All bars of all micro-batches; every bar is new, so each batch computes its series in full."""
    d = with_ordinal(bars(spark, sf)).withColumn("_turn", F.col("bar_idx") / F.col("n_bars"))
    rows = d.select(*SERIES, *BAR_COLUMNS, F.lit(True).alias("is_final"), F.col("bar_idx").alias("seq"), "_turn")
    path, out = in_files(rows, 2), fresh_folder(spark, "stream")
    stream = live.read_stream(spark, path, spark.read.parquet(path).schema)
    live.refresh_stream(stream, f"{out}/bars", f"{out}/signals", f"{out}/ckpt", FLAGSHIP).awaitTermination()
    got = spark.read.parquet(f"{out}/signals-touched")
    return rounded(got.select(F.col("batch").cast("long").alias("batch"), "symbol", "open_time", "smoothed", "signal"))


# A second batch of partial bars touches only the last 40 bars, so only the tail is computed again.
PARTIAL = f"""{HOURLY}, nb AS (SELECT * REPLACE (CASE WHEN bar_idx >= n_bars - 40 THEN close * 1.01::DOUBLE ELSE close END AS close) FROM ib),
  {smooth_sql()}, {signals_sql()}, tb AS (SELECT symbol, "interval", open_time, open, high, low, close, bar_idx - greatest(n_bars - 256, 0) AS bar_idx,
    least(n_bars, 256) AS n_bars, greatest(n_bars - 256, 0) AS shift FROM nb WHERE bar_idx >= n_bars - 256),
  {smooth_sql(source='tb', name='ts')}, {signals_sql(source='ts', name='tg')}"""


@query("t6_partial_refresh", with_(PARTIAL, f"""SELECT symbol, bar_idx, {rs('smoothed')}, signal FROM sig WHERE bar_idx < n_bars - 256
  UNION ALL SELECT symbol, bar_idx + shift, {rs('smoothed')}, signal FROM tg"""))
def t6_partial(spark, sf):
    d = stage(with_ordinal(bars(spark, sf)))
    late = F.col("bar_idx") >= F.col("n_bars") - 40
    first = d.withColumn("is_final", F.lit(True)).withColumn("seq", F.col("bar_idx")).withColumn("_turn", F.lit(0.0))
    second = d.where(late).withColumn("close", F.col("close") * 1.01).withColumn("is_final", F.lit(False)).withColumn(
        "seq", F.col("bar_idx") + 1).withColumn("_turn", F.lit(0.5))
    path, out = in_files(first.unionByName(second).drop("bar_idx", "n_bars"), 2), fresh_folder(spark, "stream")
    stream = live.read_stream(spark, path, spark.read.parquet(path).schema)
    live.refresh_stream(stream, f"{out}/bars", f"{out}/signals", f"{out}/ckpt", FLAGSHIP).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/signals").select("symbol", "bar_idx", "smoothed", "signal"))


class Died(Exception):
    pass


# The second batch dies once its bars are in the store: a new partial bar for each series, and partial bars of the last 40.
REPLAYED = f"""{HOURLY}, nb AS (SELECT * REPLACE (CASE WHEN bar_idx >= n_bars - 40 THEN close * 1.01::DOUBLE ELSE close END AS close) FROM ib),
  {smooth_sql(source='nb')}, {signals_sql()}, tb AS (SELECT symbol, "interval", open_time, open, high, low, close, bar_idx - greatest(n_bars - 256, 0) AS bar_idx,
    least(n_bars, 256) AS n_bars, greatest(n_bars - 256, 0) AS shift FROM nb WHERE bar_idx >= n_bars - 256),
  {smooth_sql(name='os')}, {signals_sql(source='os', name='og')},
  {smooth_sql(source='tb', name='ts')}, {signals_sql(source='ts', name='tg')}"""


@query("t6_replayed_batch", with_(REPLAYED, f"""SELECT symbol, bar_idx, {rs('smoothed')}, signal FROM sig WHERE symbol LIKE '%i%'
  UNION ALL SELECT symbol, bar_idx, {rs('smoothed')}, signal FROM og WHERE symbol NOT LIKE '%i%' AND bar_idx < n_bars - 256
  UNION ALL SELECT symbol, bar_idx + shift, {rs('smoothed')}, signal FROM tg WHERE symbol NOT LIKE '%i%'"""))
def t6_replayed(spark, sf):
    """A micro-batch that dies after its merge and is replayed: series with a new bar are still computed in full.

    Series with an ``i`` get their last bar only in the second batch; the others updates of bars they had.
    """
    d = stage(with_ordinal(bars(spark, sf)))
    last, newly = F.col("bar_idx") == F.col("n_bars") - 1, F.col("symbol").like("%i%")
    first = d.where(~(last & newly)).withColumn("is_final", F.lit(True)).withColumn("seq", F.col("bar_idx")).withColumn("_turn", F.lit(0.0))
    second = d.where(F.col("bar_idx") >= F.col("n_bars") - 40).withColumn("close", F.col("close") * 1.01).withColumn(
        "is_final", F.lit(False)).withColumn("seq", F.col("bar_idx") + 1).withColumn("_turn", F.lit(0.5))
    path, out = in_files(first.unionByName(second).drop("bar_idx", "n_bars"), 2), fresh_folder(spark, "stream")
    schema = spark.read.parquet(path).schema
    refresh = live.LiveRefresh(f"{out}/bars", f"{out}/signals", f"{out}/ckpt", FLAGSHIP)

    def dying(batch, batch_id):
        if batch_id == 0:
            return refresh(batch, batch_id)
        refresh.merge(refresh.decide(batch, batch_id)[0], batch_id)
        raise Died("after the merge")

    try:
        live.read_stream(spark, path, schema).writeStream.foreachBatch(dying).option("checkpointLocation", f"{out}/ckpt").trigger(**live.ONCE).start().awaitTermination()
    except StreamingQueryException as stopped:
        if "after the merge" not in str(stopped):
            raise
    live.refresh_stream(live.read_stream(spark, path, schema), f"{out}/bars", f"{out}/signals", f"{out}/ckpt", FLAGSHIP).awaitTermination()
    return rounded(spark.read.parquet(f"{out}/signals").select("symbol", "bar_idx", "smoothed", "signal"))


@query("t2_late_older_version", with_(LIVE, f"SELECT symbol, open_time, {r('CASE WHEN open_bar THEN open ELSE close END', 'close')}, trades FROM lv"))
def t2_late(spark, sf):
    """Partial bars that come a batch after the final ones change nothing."""
    m = messages(spark, sf).withColumn("_turn", F.when(F.col("is_final"), 0.0).otherwise(0.5))
    path, out = in_files(m, 2), fresh_folder(spark, "stream")
    stream = live.read_stream(spark, path, spark.read.parquet(path).schema)
    live.upsert_stream(stream, f"{out}/bars", f"{out}/ckpt").awaitTermination()
    return rounded(store.read_bars(spark, f"{out}/bars").select("symbol", "open_time", "close", "trades"))


@query("t5_backfill_merge", with_(LIVE, f"SELECT symbol, open_time, {rs('close')}, symbol LIKE '%i%' AND open_bar AS updated FROM lv"))
def t5_merge(spark, sf):
    """The store lacks the last five bars of each series; a snapshot of some series brings theirs."""
    d = stage(with_ordinal(bars(spark, sf)))
    out = fresh_folder(spark, "stream")
    store.write_bars(d.where("bar_idx < n_bars - 5 or symbol not like '%i%'"), f"{out}/bars")
    snapshot = d.where("symbol like '%i%' and bar_idx >= n_bars - 20").select(*SERIES, *BAR_COLUMNS)
    told = live.merge_backfill(spark, f"{out}/bars", snapshot, f"{out}/merge").select(*SERIES, "open_time", F.lit(True).alias("updated"))
    stored = store.read_bars(spark, f"{out}/bars").join(told, [*SERIES, "open_time"], "left")
    return rounded(stored.select("symbol", "open_time", "close", F.coalesce("updated", F.lit(False)).alias("updated")))


@query("t7_refresh_decision", with_(LIVE, "SELECT symbol, CASE WHEN symbol = 'click' THEN 'cached' WHEN bool_or(NOT open_bar AND symbol <> 'view') THEN 'full' ELSE 'tail' END AS refresh FROM lv GROUP BY symbol"))
def t7(spark, sf):
    log = messages(spark, sf).where("symbol <> 'click' and (symbol <> 'view' or not is_final)").withColumn("source", F.lit("ws"))
    return live.refresh_decision(log, series=bars(spark, sf)).drop("interval")


@query("t8_stream_bars", with_(f"{TICKS}, {bars_sql()}", f"SELECT symbol, open_time, {rs('open high low close volume')}, trades FROM bars"))
def t8(spark, sf):
    t = ticks(spark, sf).withColumn("_turn", F.dayofmonth("ts") / F.lit(32.0))
    path = in_files(t, 3)
    out = fresh_folder(spark, "stream")
    stream = live.read_stream(spark, path, spark.read.parquet(path).schema)
    live.store_stream_bars(stream, f"{out}/bars", f"{out}/ckpt", "1h").awaitTermination()
    got = store.read_bars(spark, f"{out}/bars").select("symbol", "open_time", "open", "high", "low", "close", "volume", "trades")
    return rounded(got)
