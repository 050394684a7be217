"""Backtests as relational plans.

A signal on bar t fills at the open of bar t+1; frames therefore carry ``sig1``, the signal of the
bar before.  ``positions`` replays the long-only account over chunks of bars: every chunk is
summarised on its own, windows over the (few) summaries give the account state entering each chunk,
and the bars are then priced chunk by chunk.  No task holds a whole series.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.columns import fixed_risk_size, holds, volatility_size
from tidemark.operators.chains import taken_in_turn
from tidemark.operators.series import (
    chunk_window,
    chunks_between,
    drop_halo,
    home_chunk,
    lay_out,
    running,
)
from tidemark.plans.staging import stage
from tidemark.schema import SERIES


@dataclass(frozen=True)
class Account:
    """Money settings of a backtest."""

    capital: float = 10000.0
    fee: float = 0.001
    slippage: float = 0.0005
    mode: str = "full"  # "full": spend a fraction of cash; "fixed": buy ``fraction`` units
    fraction: float = 1.0
    shorts: bool = False
    max_bars: int | None = None
    sizing: str = "fixed"  # "fixed" (use mode), "volatility" or "fixed_risk"
    volatility_target: float = 0.02
    max_risk: float = 0.02
    profit_steps: tuple[tuple[float, float], ...] = ()  # recorded only, never closes anything


#: Columns that, where a frame has them, stand for the account's own settings: one value for each key.
MONEY = ("initial_capital", "fee_rate", "slippage")


def money(df: DataFrame, account: Account) -> tuple[Column, Column, Column]:
    """Capital, fee and slippage of each row."""
    own = zip(MONEY, (account.capital, account.fee, account.slippage))
    return tuple(F.col(name) if name in df.columns else F.lit(float(value)) for name, value in own)


def with_previous_signal(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Chunk the bars and add ``sig1``."""
    laid = lay_out(df, back=1)
    return drop_halo(laid.withColumn("sig1", F.lag("signal").over(chunk_window(keys))))


def positions(df: DataFrame, keys: list[str] = SERIES, account: Account = Account()) -> DataFrame:
    """Per-bar account of the long-only, spend-a-fraction backtest.

    Input: chunked bars with ``sig1`` and ``n_bars``.  Adds ``pos`` (1 in a position during the bar), ``leaves``
    (position closed at this open), ``entry`` (struct bar_idx, open_time, open of the entry bar),
    ``cash`` (account value when flat), ``equity``, ``ret``, ``peak`` and ``drawdown``. Columns of MONEY, if there,
    stand for the account's settings.
    """
    f = account.fraction
    if account.mode != "full" or not 0 < f <= 1:
        raise ValueError("positions() replays mode='full' with 0 < fraction <= 1; see replay()")
    capital, fee, slip = money(df, account)
    settings = [F.first(c).alias(c) for c in MONEY if c in df.columns]

    def marked(entry_open: Column, close: Column) -> Column:
        return (1 - f) + F.try_divide(f * close, entry_open * (1 + slip) * (1 + fee))

    def closed(entry_open: Column, exit_open: Column) -> Column:
        return marked(entry_open, exit_open * (1 - slip) * (1 - fee))

    cells = [*keys, "chunk"]
    at = Window.partitionBy(*cells).orderBy("bar_idx")
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    bar = F.struct("bar_idx", "open_time", "open")
    nz = F.when(F.col("sig1").isin(1, -1), F.col("sig1"))
    d = df.withColumn("_nz", nz).withColumn("_st", F.last("_nz", ignorenulls=True).over(so_far))

    # 1. Each chunk that has a successor, on its own. The head runs to the first -1; behind it the
    # state is known.
    loc = (
        d.where(F.col("chunk") < home_chunk(F.col("n_bars") - 1))
        .withColumns({
            "_cut": F.coalesce(F.sum(F.when(F.col("_nz") == -1, 1)).over(so_far), F.lit(0)),
            "_was": F.lag("_st").over(at),
        })
        .withColumn("_ent", F.last(F.when((F.col("_nz") == 1) & (F.col("_was") == -1), bar), True).over(so_far))
    )
    leaves_tail = holds((F.col("_nz") == -1) & (F.col("_was") == 1) & (F.col("_cut") >= 2))
    loc = loc.withColumn(
        "_m", F.product(F.when(leaves_tail, closed(F.col("_ent.open"), F.col("open"))).otherwise(1.0)).over(so_far)
    )
    in_head = F.col("_cut") == 0
    tail_value = F.col("_m") * F.when(F.col("_st") == 1, marked(F.col("_ent.open"), F.col("close"))).otherwise(1.0)
    summary = loc.groupBy(*cells).agg(
        F.min(F.when(F.col("_nz") == -1, bar)).alias("x"),
        F.min(F.when((F.col("_nz") == 1) & in_head, bar)).alias("o"),
        F.max(F.when(in_head, F.col("close"))).alias("top_all"),
        F.max(F.when(in_head & (F.col("_st") == 1), F.col("close"))).alias("top_o"),
        F.max_by("_st", "bar_idx").alias("sign"),
        F.max("_ent").alias("ent"),
        F.max_by("_m", "bar_idx").alias("m"),
        F.max(F.when(~in_head, tail_value)).alias("top_tail"),
        F.max_by("close", "bar_idx").alias("last_close"),
        *settings,
    )

    # 2. State leaving each chunk = entering the next, from windows over the summaries.
    order = Window.partitionBy(*keys).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = summary.withColumn("in_st", F.last("sign", ignorenulls=True).over(before))
    held = holds(F.col("in_st") == 1)
    s = s.withColumn(
        "own", F.when(F.col("sign") == 1, F.coalesce(F.col("ent"), F.when(~held, F.col("o"))))
    ).withColumn("in_ent", F.last("own", ignorenulls=True).over(before))
    s = s.withColumn("head_ent", F.when(held, F.col("in_ent")).otherwise(F.col("o")))
    head_m = F.coalesce(closed(F.col("head_ent.open"), F.col("x.open")), F.lit(1.0))
    s = s.withColumn("head_m", head_m).withColumn(
        "in_cash", capital * F.coalesce(F.product(F.col("head_m") * F.col("m")).over(before), F.lit(1.0))
    )
    top = F.greatest(
        F.when(held, F.col("in_cash") * marked(F.col("in_ent.open"), F.col("top_all"))).otherwise(F.col("in_cash")),
        F.when(~held, F.col("in_cash") * marked(F.col("o.open"), F.col("top_o"))),
        F.col("in_cash") * F.col("head_m") * F.col("top_tail"),
    )
    out_cash = F.col("in_cash") * F.col("head_m") * F.col("m")
    out_long = holds(F.coalesce("sign", "in_st") == 1)
    out_ent = F.coalesce(F.col("own.open"), F.col("in_ent.open"))
    out_equity = out_cash * F.when(out_long, marked(out_ent, F.col("last_close"))).otherwise(1.0)
    carry = s.withColumn("_top", top).select(
        *keys,
        (F.col("chunk") + 1).alias("chunk"),
        F.coalesce("sign", "in_st").alias("_in_st"),
        F.coalesce("own", "in_ent").alias("_in_ent"),
        out_cash.alias("_in_cash"),
        F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_in_peak"),
        out_equity.alias("_in_equity"),
    )

    # 3. Price the bars with the state they start from.
    p = d.join(carry, cells, "left").withColumns(
        {"_st": F.coalesce("_st", "_in_st"), "_in_cash": F.coalesce("_in_cash", capital)}
    )
    p = p.withColumn("_was", F.coalesce(F.lag("_st").over(at), F.col("_in_st")))
    enters = holds(F.col("_nz") == 1) & ~holds(F.col("_was") == 1)
    p = p.withColumns({
        "pos": holds(F.col("_st") == 1).cast("int"),
        "leaves": holds((F.col("_nz") == -1) & (F.col("_was") == 1)),
        "entry": F.coalesce(F.last(F.when(enters, bar), True).over(so_far), F.col("_in_ent")),
    })
    step = F.when(F.col("leaves"), closed(F.col("entry.open"), F.col("open"))).otherwise(1.0)
    p = p.withColumn("cash", F.col("_in_cash") * F.product(step).over(so_far))
    value = F.when(F.col("pos") == 1, marked(F.col("entry.open"), F.col("close"))).otherwise(1.0)
    p = p.withColumn("equity", F.col("cash") * value)
    # a flat account returns exactly zero, also across a chunk border
    idle = (F.col("bar_idx") > 0) & (F.col("pos") == 0) & ~holds(F.col("_was") == 1)
    moved = F.try_divide(F.col("equity"), F.coalesce(F.lag("equity").over(at), F.col("_in_equity"))) - 1
    p = p.withColumns({
        "peak": F.greatest("_in_peak", F.max("equity").over(so_far)),
        "ret": F.when(idle, 0.0).otherwise(moved),
    })
    return p.withColumn("drawdown", F.col("equity") - F.col("peak")).drop(
        "_nz", "_st", "_was", "_in_st", "_in_ent", "_in_cash", "_in_peak", "_in_equity"
    )


# Fixed order of the trade log's columns.
TRADE_COLUMNS = [
    "entry_idx", "exit_idx", "entry_time", "exit_time", "entry_price", "exit_price", "size", "pnl",
    "pnl_pct", "mae", "mfe", "mae_pct", "mfe_pct", "bars_held", "fees", "direction", "exit_reason",
    "partial_exits",
]
_NO_PARTIALS = "cast(null as array<struct<idx:int,price:double,size:double>>)"


def _priced(t: DataFrame, keys: list[str], account: Account) -> DataFrame:
    """Trade arithmetic shared by both backtests; needs prices, size, direction, hi, lo."""
    long = F.col("direction") == 1
    entry_cost, exit_value = F.col("size") * F.col("entry_price"), F.col("size") * F.col("exit_price")
    gross = F.when(long, exit_value - entry_cost).otherwise(entry_cost - exit_value)
    fees = (entry_cost + exit_value) * money(t, account)[1]
    up, down = F.col("hi") - F.col("entry_price"), F.col("entry_price") - F.col("lo")
    mae, mfe = F.when(long, down).otherwise(up), F.when(long, up).otherwise(down)

    def share(x: Column) -> Column:
        return F.when(F.col("entry_price") > 0, x / F.col("entry_price")).otherwise(0.0)

    t = t.withColumns({
        "fees": fees, "pnl": gross - fees, "pnl_pct": F.try_divide(gross - fees, entry_cost), "mae": mae, "mfe": mfe,
        "mae_pct": share(mae), "mfe_pct": share(mfe), "bars_held": F.col("exit_idx") - F.col("entry_idx"),
    })
    if "partial_exits" not in t.columns:
        t = t.withColumn("partial_exits", F.expr(_NO_PARTIALS))
    return t.select(*keys, *TRADE_COLUMNS)


def closed_trades(pos: DataFrame, keys: list[str] = SERIES, account: Account = Account()) -> DataFrame:
    """Trade log of ``positions``: one aggregate over the bars each trade was held."""
    _, fee, slip = money(pos, account)
    settings = [c for c in MONEY[1:] if c in pos.columns]
    held = F.col("pos") == 1
    out = F.when(F.col("leaves"), F.struct("bar_idx", "open_time", "open"))
    t = (
        pos.where(held | F.col("leaves"))
        .groupBy(*keys, F.col("entry.bar_idx").alias("entry_idx"))
        .agg(
            F.max("entry").alias("e"),
            F.max(out).alias("x"),
            F.max(F.when(held, F.col("high"))).alias("hi"),
            F.min(F.when(held, F.col("low"))).alias("lo"),
            F.max(F.when(held, F.col("cash"))).alias("cash"),
            *[F.first(c).alias(c) for c in settings],
        )
        .where(F.col("x").isNotNull())
    )
    price = F.col("e.open") * (1 + slip)
    t = t.select(
        *keys,
        "entry_idx",
        F.col("x.bar_idx").alias("exit_idx"),
        F.col("e.open_time").alias("entry_time"),
        F.col("x.open_time").alias("exit_time"),
        price.alias("entry_price"),
        (F.col("x.open") * (1 - slip)).alias("exit_price"),
        (F.col("cash") * account.fraction / (price * (1 + fee))).alias("size"),
        F.lit(1).alias("direction"),
        F.lit("signal").alias("exit_reason"),
        "hi",
        "lo",
        *settings,
    )
    return _priced(t, keys, account)


def excursions(trades: DataFrame, bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Highest high and lowest low over [entry_idx, exit_idx) of each (series, entry_idx).

    Range join as an equi-join on (series, chunk): a trade is listed under each chunk it spans.
    """
    spans = trades.select(
        *keys,
        "entry_idx",
        "exit_idx",
        F.explode(chunks_between("entry_idx", "exit_idx")).alias("chunk"),
    )
    held = bars.select(*keys, "bar_idx", "high", "low", home_chunk().alias("chunk"))
    return (
        held.join(spans, [*keys, "chunk"])
        .where((F.col("bar_idx") >= F.col("entry_idx")) & (F.col("bar_idx") < F.col("exit_idx")))
        .groupBy(*keys, "entry_idx")
        .agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    )


def mae_mfe(trades: DataFrame, bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Adverse and favourable excursion per trade; an empty or overrunning range gives zeros."""
    ranged = trades.where((F.col("entry_idx") < F.col("exit_idx")))
    both = trades.join(excursions(ranged, bars, keys), [*keys, "entry_idx"], "left")
    long = F.col("direction") == 1
    up, down = F.col("hi") - F.col("entry_price"), F.col("entry_price") - F.col("lo")
    valid = F.col("entry_idx") < F.col("exit_idx")
    return (
        both.withColumn("mae", F.when(valid, F.when(long, down).otherwise(up)).otherwise(0.0))
        .withColumn("mfe", F.when(valid, F.when(long, up).otherwise(down)).otherwise(0.0))
        .drop("hi", "lo")
    )


# --- backtest with shorts, stops, time exits and sizing ------------------------------------------

def _next_events(df: DataFrame, events: dict[str, Column], keys: list[str]) -> DataFrame:
    """Index of the first bar at or after this one where each event holds (NULL if none)."""
    backwards = df.withColumn("chunk", -home_chunk()).withColumn("_rev", -F.col("bar_idx"))
    specs = {name: ("last", F.when(holds(event), F.col("bar_idx"))) for name, event in events.items()}
    return running(backwards, specs, keys, order="_rev").drop("_rev", "chunk")


def entry_candidates(df: DataFrame, keys: list[str] = SERIES, account: Account = Account()) -> DataFrame:
    """Every bar that could open a position, with the exit it would get and its size.

    Input columns: bar_idx, n_bars, open_time, open, close, signal and, when used, ``stop`` and
    ``atr``.  Sizes are in units of available cash (``per_cash``) or in absolute ``units``.
    """
    has_stop = "stop" in df.columns
    x = lay_out(df, ahead=1)
    ahead = F.lead(F.struct("open", "open_time")).over(chunk_window(keys))
    x = drop_halo(x.withColumn("_next", ahead)).drop("chunk").where(F.col("_next").isNotNull())
    stop_long = F.col("close") < F.col("stop") if has_stop else F.lit(False)
    stop_short = F.col("close") > F.col("stop") if has_stop else F.lit(False)
    events = {"_out_long": stop_long | (F.col("signal") == -1)}
    if account.shorts:
        events["_out_short"] = stop_short | (F.col("signal") == -2)
    x = _next_events(x, events, keys)
    if not account.shorts:
        x = x.withColumn("_out_short", F.lit(None).cast("long"))
    # the position can first be left on the bar after the entry signal
    x = lay_out(x.withColumn("n_bars", F.col("n_bars") - 1), ahead=1)
    x = drop_halo(
        x.withColumn("_out_long", F.lead("_out_long").over(chunk_window(keys)))
        .withColumn("_out_short", F.lead("_out_short").over(chunk_window(keys)))
    ).drop("chunk")
    direction = F.when(F.col("signal") == 1, 1)
    if account.shorts:
        direction = direction.when(F.col("signal") == 2, -1)
    c = x.withColumn("direction", direction).where(F.col("direction").isNotNull())
    fill = F.col("_next.open") * (1 + F.col("direction") * account.slippage)
    c = c.withColumn("entry_price", fill).withColumn("entry_idx", F.col("bar_idx") + 1)
    event = F.when(F.col("direction") == 1, F.col("_out_long")).otherwise(F.col("_out_short"))
    c = c.withColumn("_event", event)
    if account.max_bars is not None:
        due = F.col("entry_idx") + F.greatest(F.lit(account.max_bars), F.lit(0))
        c = c.withColumn("_due", F.when(due <= F.col("n_bars") - 1, due))
        c = c.withColumn("left_at", F.least("_event", "_due"))
    else:
        c = c.withColumn("_due", F.lit(None).cast("long")).withColumn("left_at", F.col("_event"))
    one = F.lit(1.0)
    if account.sizing == "volatility" and has_stop and "atr" in df.columns:
        per_cash = volatility_size(one, "entry_price", "stop", "atr", account.volatility_target, account.max_risk)
        units = F.lit(None).cast("double")
    elif account.sizing == "fixed_risk" and has_stop:
        per_cash, units = fixed_risk_size(one, "entry_price", "stop", account.max_risk), F.lit(None).cast("double")
    elif account.mode == "full":
        per_cash = account.fraction / (F.col("entry_price") * (1 + account.fee))
        units = F.lit(None).cast("double")
    else:
        per_cash, units = F.lit(None).cast("double"), F.lit(float(account.fraction))
    return c.withColumn("per_cash", per_cash).withColumn("units", units).select(
        *keys, "bar_idx", "entry_idx", F.col("_next.open_time").alias("entry_time"), "entry_price",
        "direction", "per_cash", "units", "left_at", "_due",
    )


#: What the rounding of a few operations may change, relative to the cash.
_ROUNDING = 2e-15


def take_in_turn(
    candidates: DataFrame, keys: list[str] = SERIES, account: Account = Account()
) -> DataFrame:
    """The candidates of each series that are taken in turn, whenever the account is free and can pay.

    Which ones are met is settled over chunks of candidates (``chains``) as if every entry could be paid; cash
    along them is a running product (sizes in cash) or sum (sizes in units) over chunks. Where an entry cannot be
    paid, the series is walked from there on; where only the rounding of a sequential account tells whether it can
    (all of a cash of tens of thousands is spent at once), from its start. Adds ``size``, ``cash_in`` (cash left
    while the position is open) and ``cash_out``.
    """
    fee, price, out = account.fee, F.col("entry_price"), F.col("exit_price")
    ratio = F.col("per_cash") * price * (1 + fee)
    payable = (F.col("per_cash") > 0) & (ratio <= 1 + 1e-9) | F.col("per_cash").isNull() & (F.col("units") > 0)
    candidates = stage(candidates)
    met = taken_in_turn(candidates.where(payable).select(*keys, "bar_idx", (F.col("left_at") + 1).alias("free")), keys)
    kept = candidates.join(met, [*keys, "bar_idx"], "left_semi")
    # what a closed position adds, for each unit of its size
    gain = F.when(F.col("left_at").isNotNull(), F.col("direction") * (out - price) - fee * (out + price) - F.when(F.col("direction") == 1, 0.0).otherwise(fee * price))
    gain = F.coalesce(gain, F.lit(0.0))
    in_units = F.col("per_cash").isNull()
    steps = {"_factor": ("product", F.when(in_units, 1.0).otherwise(1 + F.col("per_cash") * gain)), "_added": ("sum", F.when(in_units, F.col("units") * gain).otherwise(0.0))}
    # an account sizes either way throughout, so the two do not mix
    d = running(kept.withColumn("_order", F.col("bar_idx")), steps, keys, order="_order", inclusive=False).drop("_order", "chunk")
    d = d.withColumn("_cash", account.capital * F.col("_factor") + F.col("_added")).drop("_factor", "_added")
    d = d.withColumn("size", F.when(in_units, F.col("units")).otherwise(F.col("per_cash") * F.col("_cash")))
    cost = F.col("size") * price
    spare = F.col("_cash") + 1e-10 - cost * (1 + fee)
    usable = holds((F.col("size") > 0) & (in_units | (F.col("_cash") >= 1)))
    d = stage(d.withColumns({
        "cash_in": F.col("_cash") - cost * (1 + fee),
        "_paid": usable & (spare >= 0), "_unclear": usable & (F.abs(spare) <= _ROUNDING * F.col("_cash")),
        "cash_out": F.when(F.col("left_at").isNotNull(), F.col("_cash") + F.col("size") * gain),
    }))
    broke = d.where(~F.col("_paid") | F.col("_unclear")).groupBy(*keys).agg(
        F.when(F.bool_or("_unclear"), -1).otherwise(F.min("bar_idx")).alias("_stop"),
        F.when(F.bool_or("_unclear"), account.capital).otherwise(F.min_by("_cash", "bar_idx")).alias("_start"))
    columns = [
        *keys, "bar_idx", "entry_idx", "entry_time", "entry_price", "direction", "left_at", "_due",
        "exit_time", "exit_price", "exit_event",
    ]
    before = d.join(broke, keys, "left").where("_stop is null or bar_idx < _stop").select(*columns, "size", "cash_in", "cash_out")
    rest = candidates.join(broke, keys).where("bar_idx >= _stop")
    return before.unionByName(_walk(rest, columns, keys, account))


def _walk(candidates: DataFrame, columns: list[str], keys: list[str], account: Account) -> DataFrame:
    """One candidate after the other, from the cash in ``_start``; rows stream through in Arrow batches."""
    fee = account.fee
    schema = candidates.select(*columns).schema
    out = T.StructType([*schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("size", "cash_in", "cash_out")]])

    def walk(batches):
        current, free, cash = None, -1, 0.0
        for pdf in batches:
            taken = []
            series = list(zip(*[pdf[k] for k in keys]))
            idx, start = pdf["bar_idx"].to_numpy(), pdf["_start"].to_numpy()
            left = pdf["left_at"].to_numpy(float)
            price, way = pdf["entry_price"].to_numpy(), pdf["direction"].to_numpy()
            leave_price = pdf["exit_price"].to_numpy(float)
            share, fixed = pdf["per_cash"].to_numpy(float), pdf["units"].to_numpy(float)
            for i, key in enumerate(series):
                if key != current:
                    current, free, cash = key, -1, start[i]
                if idx[i] < free:
                    continue
                size = cash * share[i] if share[i] == share[i] else fixed[i]
                cost = size * price[i]
                if not (size > 0 and cost * (1 + fee) <= cash + 1e-10):
                    continue
                open_cash = cash - cost * (1 + fee)
                if left[i] == left[i]:
                    value = size * leave_price[i]
                    gain = value - cost if way[i] == 1 else cost - value
                    entry_fee_again = 0.0 if way[i] == 1 else cost * fee
                    cash = open_cash + cost + gain - value * fee - entry_fee_again
                    free = left[i] + 1
                    taken.append((i, size, open_cash, cash))
                else:
                    free = float("inf")
                    taken.append((i, size, open_cash, None))
            rows = pdf.iloc[[t[0] for t in taken]][columns].copy()
            rows["size"] = [t[1] for t in taken]
            rows["cash_in"] = [t[2] for t in taken]
            rows["cash_out"] = pd.array([t[3] for t in taken], dtype="Float64")
            yield rows

    ordered = candidates.repartition(*keys).sortWithinPartitions(*keys, "bar_idx")
    return ordered.mapInPandas(walk, out)


def replay(df: DataFrame, keys: list[str] = SERIES, account: Account = Account()) -> tuple[DataFrame, DataFrame]:
    """Backtest with shorts, stop and time exits and every sizing mode: (equity bars, trades)."""
    # ``left_at`` is the bar whose close decides; the fill is the next open
    stop = F.col("stop") if "stop" in df.columns else F.lit(None).cast("double")
    decided = df.select(*keys, "bar_idx", "n_bars", "open_time", "open", F.struct("close", stop.alias("stop")).alias("_at"))
    following = F.lead(F.struct("open", "open_time")).over(chunk_window(keys))
    fills = drop_halo(lay_out(decided, ahead=1).withColumn("_fill", following)).select(
        *keys, F.col("bar_idx").alias("left_at"), F.col("_fill.open_time").alias("exit_time"),
        F.col("_fill.open").alias("_exit_open"), "_at",
    )
    c = entry_candidates(df, keys, account).join(fills, [*keys, "left_at"], "left")
    stopped = F.when(F.col("direction") == 1, F.col("_at.close") < F.col("_at.stop")).otherwise(
        F.col("_at.close") > F.col("_at.stop")
    )
    reason = F.when(holds(stopped), "stop").when(holds(F.col("_due") <= F.col("left_at")), "time").otherwise("signal")
    c = c.withColumn("exit_event", reason).withColumn(
        "exit_price", F.col("_exit_open") * (1 - F.col("direction") * account.slippage)
    )
    c = c.drop("_at", "_exit_open")
    taken = take_in_turn(c, keys, account).withColumn("exit_idx", F.col("left_at") + 1)

    closed = taken.where(F.col("left_at").isNotNull())
    ranged = closed.join(excursions(closed, df, keys), [*keys, "entry_idx"]).withColumn("exit_reason", F.col("exit_event"))
    trades = _priced(ranged, keys, account)

    opened = taken.select(
        *keys, F.col("entry_idx").alias("bar_idx"),
        F.struct(F.col("cash_in").alias("cash"), F.col("size").alias("units")).alias("_open"),
    )
    freed = closed.select(
        *keys, F.col("exit_idx").alias("bar_idx"),
        F.struct(F.col("cash_out").alias("cash"), F.lit(0.0).alias("units")).alias("_free"),
    )
    bars = df.join(opened, [*keys, "bar_idx"], "left").join(freed, [*keys, "bar_idx"], "left")
    held = running(bars, {"_hold": ("last", F.coalesce("_open", "_free"))}, keys)
    equity = F.coalesce(F.col("_hold.cash"), F.lit(float(account.capital))) + F.coalesce(
        F.col("_hold.units"), F.lit(0.0)
    ) * F.col("close")
    return held.withColumn("equity", equity).drop("_open", "_free", "_hold", "chunk"), trades


def profit_levels(trades: DataFrame, steps: list[tuple[float, float]], keys: list[str] = SERIES) -> DataFrame:
    """Take-profit price per (trade, level)."""
    levels = F.array(*[
        F.struct(F.lit(i).alias("level"), F.lit(float(p)).alias("pct"), F.lit(float(s)).alias("share"))
        for i, (p, s) in enumerate(steps)
    ])
    t = trades.withColumn("_l", F.explode(levels))
    return t.select(
        *trades.columns, F.col("_l.level").alias("level"), F.col("_l.share").alias("share"),
        (F.col("entry_price") * (1 + F.col("direction") * F.col("_l.pct"))).alias("level_price"),
    )


def profit_hits(levels: DataFrame, bars: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """First held bar reaching each take-profit level (levels never reached are absent)."""
    spans = levels.withColumn("chunk", F.explode(chunks_between("entry_idx", "exit_idx"))).select(*keys, "chunk", "entry_idx", "exit_idx", "direction", "level", "level_price")
    held = bars.select(*keys, "bar_idx", "high", "low", home_chunk().alias("chunk"))
    reached = F.when(F.col("direction") == 1, F.col("high") >= F.col("level_price")).otherwise(
        F.col("low") <= F.col("level_price")
    )
    return (
        held.join(spans, [*keys, "chunk"])
        .where((F.col("bar_idx") >= F.col("entry_idx")) & (F.col("bar_idx") < F.col("exit_idx")) & reached)
        .groupBy(*keys, "entry_idx", "level")
        .agg(F.first("level_price").alias("level_price"), F.min("bar_idx").alias("hit_idx"))
    )
