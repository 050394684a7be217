"""Parameter search (O1-O17), Monte Carlo (M1-M5), result sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ACCOUNT, HOURLY, METRIC_NAMES, SMOOTHED, bars, indexed, metrics_sql, query, r, replay_sql, rounded, rs,
    smooth_sql, table, trades_sql, with_,
)
from catalog.backtests import flagship
from catalog.signals import TR, smoothed
from tidemark.operators import align, montecarlo as mc, search as so
from tidemark.plans import optimise as op
from tidemark.plans.staging import fresh_folder, stage
from tidemark.schema import SERIES
from tidemark.sources import sinks

GRID = {"a": so.Axis("int", 1, 3), "b": so.Axis("float", 0.1, 10.0, log=True), "c": so.Axis("float", 0.0, 1.0), "d": so.Axis("choice", choices=("x", "y"))}


@query("o1_grid_candidates", f"""SELECT s_suppkey, ((i * 3 + j) * 3 + k) * 2 + l AS param_id, 1 + i AS a, round(power(10.0::DOUBLE, j - 1), 7) AS b,
  k * 0.5::DOUBLE AS c, CASE l WHEN 0 THEN 'x' ELSE 'y' END AS d FROM supplier, range(3) t1(i), range(3) t2(j), range(3) t3(k), range(2) t4(l)""")
def o1(spark, sf):
    return rounded(so.grid_candidates(table(spark, sf, "supplier").select("s_suppkey"), GRID, 3))


@query("j5_parameter_product", """SELECT s_suppkey, i * 4 + j AS param_id, CAST(floor(1 + i) AS INT) AS a, round(j / 3.0::DOUBLE, 7) AS c
  FROM supplier, range(4) t1(i), range(4) t2(j)""")
def j5(spark, sf):
    space = {"a": so.Axis("int", 1, 4), "c": so.Axis("float", 0.0, 1.0)}
    return rounded(so.grid_candidates(table(spark, sf, "supplier").select("s_suppkey"), space, 4))


def hash_sql(row: str, stream: str, seed: int) -> str:
    x = f"((({row})::BIGINT * 2654435761 + ({stream})::BIGINT * 40503 + {seed * 9973}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x} >> 16, {x}) * 73244475) % 4294967296)"
    return f"xor({x} >> 16, {x})"


def uniform_sql(row: str, stream: str, seed: int) -> str:
    return f"({hash_sql(row, stream, seed)} / 4294967296.0::DOUBLE)"


@query("o2_random_candidates", f"""SELECT s_suppkey, param_id, CAST(1 + floor(u0 * 3) AS INT) AS a, {r('power(10.0::DOUBLE, -1 + u1 * 2)', 'b', 6)}, {r('u2', 'c', 6)},
  CASE floor(u3 * 2) WHEN 0 THEN 'x' ELSE 'y' END AS d FROM (SELECT s_suppkey, param_id, {', '.join(f"{uniform_sql('param_id', str(i), 7)} AS u{i}" for i in range(4))}
  FROM supplier, range(100) t(param_id))""")
def o2(spark, sf):
    return rounded(so.random_candidates(table(spark, sf, "supplier").select("s_suppkey"), GRID, 100, 7), 6)


# --- evaluating candidates ----------------------------------------------------------------------

SPACE = {
    "min_trend_period_hours": so.Axis("float", 12.0, 48.0), "atr_period": so.Axis("int", 7, 28),
    "slope_lookback": so.Axis("int", 1, 3),
}
NAMES = list(SPACE)
GRID8 = op.Search(SPACE, "grid", points=2)
RANDOM = op.Search(SPACE, "random", n=4, seed=3)
GRID8_SQL = """par AS (SELECT i * 4 + j * 2 + k AS param_id, 12.0::DOUBLE + 36 * i AS hours, 7 + 21 * j AS period, 1 + 2 * k AS lookback
  FROM range(2) t1(i), range(2) t2(j), range(2) t3(k))"""


def random_sql(seed: int) -> str:
    drawn = ", ".join(f"{uniform_sql('param_id', str(i), seed)} AS u{i}" for i in range(3))
    return f"""par AS (SELECT param_id, 12 + u0 * 36 AS hours, 7 + floor(u1 * 22) AS period, 1 + CAST(floor(u2 * 3) AS INT) AS lookback
  FROM (SELECT param_id, {drawn} FROM range(4) t(param_id)))"""


RANDOM_SQL = random_sql(3)
PB = "pb AS (SELECT tr0.*, par.* FROM tr0, par)"


def objective_sql(source: str = "pb", keys: str = "symbol, param_id", p: str = "") -> str:
    """Smooth, ATR-stop, signal and account per key; ``p`` prefixes every CTE."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k} = e.{k}" for k in ks)
    sk = ", ".join(f"s.{k}" for k in ks)
    w = f"(PARTITION BY {keys} ORDER BY bar_idx)"
    return f"""{smooth_sql(period='trunc(hours)', source=source, name=p + 'sm', keys=keys)},
  {p}ar AS (SELECT {keys}, bar_idx, tr AS atr FROM {source} WHERE bar_idx = 0 UNION ALL SELECT {sk}, s.bar_idx,
    s.tr * 2.0::DOUBLE / (s.period + 1) + e.atr * (s.period - 1) / (s.period + 1) FROM {p}ar e JOIN {source} s ON {on} AND s.bar_idx = e.bar_idx + 1),
  {p}sg AS (SELECT *, lag(signal) OVER {w} AS sig1 FROM (SELECT *, CASE WHEN (pc >= ps AND close < smoothed) OR close < close - 2 * atr THEN -1
    WHEN pc <= ps AND close > smoothed AND smoothed > back THEN 1 ELSE 0 END AS signal FROM (SELECT *, lag(close) OVER {w} AS pc, lag(smoothed) OVER {w} AS ps,
    CASE lookback WHEN 1 THEN lag(smoothed, 1) OVER {w} WHEN 2 THEN lag(smoothed, 2) OVER {w} ELSE lag(smoothed, 3) OVER {w} END AS back
    FROM {p}sm JOIN {p}ar USING ({keys}, bar_idx)))),
  {replay_sql(p + 'sg', p + 'acc', keys)}, {trades_sql(p + 'acc', p + 'tr', keys, source)}, {metrics_sql(p + 'acc', p + 'tr', p + 'met', keys)}"""


OBJ = f"{TR}, {GRID8_SQL}, {PB}, {objective_sql()}"
MSEL = f"n_trades, n_wins, n_losses, {rs(METRIC_NAMES, 6)}"


def prepared(spark, sf):
    return stage(op.prepare(bars(spark, sf)))


def grid_run(spark, sf):
    return op.search(prepared(spark, sf), GRID8)


@query("o5_candidate_evaluation", with_(OBJ, f"SELECT symbol, param_id, hours AS min_trend_period_hours, period AS atr_period, lookback AS slope_lookback, {MSEL} FROM met JOIN par USING (param_id)"))
def o5(spark, sf):
    return rounded(grid_run(spark, sf).drop("interval"), 6)


# Every candidate trades its own capital at its own fee and slippage. None of them is free: bars that open and close at
# one price would return nothing but rounding, and its sign would decide what counts as downside.
MONEY = {
    "min_trend_period_hours": so.Axis("float", 12.0, 48.0), "initial_capital": so.Axis("float", 5000.0, 20000.0),
    "fee_rate": so.Axis("float", 0.0005, 0.002), "slippage": so.Axis("float", 0.00025, 0.001),
}
MONEY_SQL = f"""{TR}, par AS (SELECT i * 8 + j * 4 + k * 2 + l AS param_id, 12.0::DOUBLE + 36 * i AS hours, 14 AS period, 1 AS lookback,
  5000.0::DOUBLE + 15000 * j AS capital, 0.0005::DOUBLE + 0.0015::DOUBLE * k AS fee, 0.00025::DOUBLE + 0.00075::DOUBLE * l AS slip FROM range(2) t1(i), range(2) t2(j), range(2) t3(k), range(2) t4(l)), {PB},
  """ + objective_sql().replace("1.0005::DOUBLE", "(1 + s.slip)").replace("0.9995::DOUBLE", "(1 - s.slip)").replace("1.001::DOUBLE", "(1 + s.fee)").replace(
    "0.999::DOUBLE", "(1 - s.fee)").replace("10000.0::DOUBLE", "capital").replace("0.001 *", "fee *").replace("FROM acc JOIN tr_h h USING (symbol, param_id)", "FROM acc JOIN par USING (param_id) JOIN tr_h h USING (symbol, param_id)").replace(
    "FROM acc),", "FROM acc JOIN par USING (param_id)),").replace("10000", "any_value(capital)")


# without fees annualised returns run to 1e45, so their logarithm is compared
@query("o5_fee_axis", with_(MONEY_SQL, f"""SELECT symbol, param_id, hours AS min_trend_period_hours, capital AS initial_capital, fee AS fee_rate, slip AS slippage,
  n_trades, n_wins, n_losses, {r('log10(nullif(1 + annualized_return, 0))', 'annualized_log10', 6)}, {rs(METRIC_NAMES.replace('annualized_return ', ''), 6)} FROM met JOIN par USING (param_id)"""))
def o5_money(spark, sf):
    d = op.search(prepared(spark, sf), op.Search(MONEY, "grid", points=2)).withColumn("annualized_log10", F.log10(1 + F.col("annualized_return")))
    return rounded(d.drop("interval", "annualized_return"), 6)


@query("o8_money_bayesian_start", with_(MONEY_SQL.replace("par AS (SELECT", "par AS (SELECT * FROM (SELECT", 1).replace("t4(l))", "t4(l)) WHERE param_id IN (3, 12))", 1),
  f"SELECT symbol, param_id, {rs('sharpe_ratio total_return', 6)} FROM met"))
def o8_money(spark, sf):
    """Given candidates, as a search of one's own would propose them, with money settings of their own."""
    rows = [(3, 12.0, 5000.0, 0.002, 0.001), (12, 48.0, 20000.0, 0.0005, 0.00025)]
    chosen = spark.createDataFrame(rows, "param_id long, min_trend_period_hours double, initial_capital double, fee_rate double, slippage double")
    d = prepared(spark, sf).withColumn("param_id", F.explode(F.array(F.lit(3).cast("long"), F.lit(12).cast("long")))).join(chosen, "param_id")
    return rounded(op.evaluate(d, [*SERIES, "param_id"], lookbacks=[1]).select("symbol", "param_id", "sharpe_ratio", "total_return"), 6)


@query("u3_objective_plugin", with_(f"{TR}, {RANDOM_SQL}, {PB}, {objective_sql()}", f"SELECT symbol, param_id, {MSEL} FROM met"))
def u3(spark, sf):
    d = so.with_candidates(prepared(spark, sf), RANDOM.size, RANDOM.columns(F.col("param_id")))
    return rounded(op.evaluate(d, [*SERIES, "param_id"], lookbacks=[1, 2, 3]).drop("interval"), 6)


BEST = "best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC, param_id) = 1)"


@query("o6_best_result", with_(f"{OBJ}, {BEST}", f"SELECT symbol, param_id, {rs('sharpe_ratio total_return', 6)} FROM best"))
def o6(spark, sf):
    return rounded(so.best_result(grid_run(spark, sf), "sharpe_ratio", SERIES).select("symbol", "param_id", "sharpe_ratio", "total_return"), 6)


BOARD = "hours AS min_trend_period_hours, period AS atr_period, lookback AS slope_lookback"


def board_of(spark, sf):
    return so.leaderboard(grid_run(spark, sf), NAMES, ["sharpe_ratio", "total_return", "max_drawdown_pct"], "sharpe_ratio", SERIES)


@query("o7_leaderboard", with_(OBJ, f"SELECT symbol, param_id, {BOARD}, {r('sharpe_ratio', 'train_sharpe_ratio', 6)}, {r('total_return', 'train_total_return', 6)}, {r('max_drawdown_pct', 'train_max_drawdown_pct', 6)} FROM met JOIN par USING (param_id)"))
def o7(spark, sf):
    return rounded(board_of(spark, sf).drop("interval"), 6)


@query("b7_top20", with_(OBJ, f"SELECT symbol, param_id, {r('sharpe_ratio', 'train_sharpe_ratio', 6)} FROM met ORDER BY met.sharpe_ratio DESC, symbol, param_id LIMIT 20"))
def b7(spark, sf):
    return rounded(board_of(spark, sf).select("symbol", "param_id", "train_sharpe_ratio").limit(20), 6)


# Choices that are not evenly spaced, for both whole-number parameters.
CHOICE = op.Search({"atr_period": so.Axis("choice", choices=(7, 21)), "slope_lookback": so.Axis("choice", choices=(1, 3))}, "grid", points=2)
CHOICE_SQL = """par AS (SELECT i * 2 + j AS param_id, 48.0::DOUBLE AS hours, 7 + 14 * i AS period, 1 + 2 * j AS lookback FROM range(2) t1(i), range(2) t2(j))"""


@query("o8_choice_axes", with_(f"{TR}, {CHOICE_SQL}, {PB}, {objective_sql()}", f"SELECT symbol, param_id, period AS atr_period, lookback AS slope_lookback, {MSEL} FROM met JOIN par USING (param_id)"))
def o8_choice(spark, sf):
    return rounded(op.search(prepared(spark, sf), CHOICE).drop("interval"), 6)


# One series cannot be traded at: its opens are zero. The others are scored as ever.
@query("o5_bad_series", with_(OBJ, f"""SELECT symbol, param_id, CASE WHEN symbol = 'view' THEN '-inf'::DOUBLE ELSE q END AS sharpe_ratio
  FROM (SELECT symbol, param_id, {r('sharpe_ratio', 'q', 6)} FROM met)"""))
def o5_bad(spark, sf):
    d = prepared(spark, sf).withColumn("open", F.when(F.col("symbol") == "view", 0.0).otherwise(F.col("open")))
    return rounded(op.search(d, GRID8).select("symbol", "param_id", "sharpe_ratio"), 6)


@query("o8_random_search", with_(f"{TR}, {RANDOM_SQL}, {PB}, {objective_sql()}", f"SELECT symbol, param_id, {r('hours', 'min_trend_period_hours', 6)}, period::INT AS atr_period, lookback AS slope_lookback, {r('sharpe_ratio', None, 6)}, n_trades FROM met JOIN par USING (param_id)"))
def o8(spark, sf):
    out = op.search(prepared(spark, sf), RANDOM)
    return rounded(out.select("symbol", "param_id", *NAMES, "sharpe_ratio", "n_trades"), 6)


def corner_of(i: int) -> list[str]:
    return [str(i // 4), str(i // 2 % 2), str(i % 2)]


def posterior_sql(n: int, n_iter: int, samples: int, seed: int, place=corner_of) -> str:
    """``gp`` (symbol, p, u0, u1, u2, mean, dev, best): what n observed candidates tell of each drawn point.

    ``place`` gives a candidate's coordinates, by default those of the corners of the grid.

    Observations are taken in one after the other; each corrects the mean, the variance and what is left of the
    covariances. One without a finite score has no covariance with anything.
    """
    apart = lambda i, j: " + ".join(f"power({x} - {y}, 2)" for x, y in zip(place(i), place(j)))
    near = lambda i: f"exp(-0.5::DOUBLE * ({' + '.join(f'power(u{d} - {x}, 2)' for d, x in enumerate(place(i)))}) / 0.09::DOUBLE)"
    finite = lambda i: f"FILTER (param_id = {i} AND isfinite(sharpe_ratio))"
    seen = ", ".join(f"coalesce(max(sharpe_ratio) {finite(i)}, 0) AS y{i}, count(*) {finite(i)} AS o{i}" for i in range(n))
    drawn = ", ".join(f"{uniform_sql('p', str(1000 + d), seed)} AS u{d}" for d in range(3))
    pair = lambda i, j: "1.00001::DOUBLE" if i == j else f"o{i} * o{j} * exp(-0.5::DOUBLE * ({apart(i, j)}) / 0.09::DOUBLE)"
    first = ", ".join([
        *(f"{pair(i, j)} AS a{i}_{j}" for i in range(n) for j in range(i, n)), *(f"o{i} * {near(i)} AS c{i}" for i in range(n)), *(f"y{i}" for i in range(n))])
    steps = [f"""kn AS (SELECT symbol, coalesce(max(sharpe_ratio) FILTER (isfinite(sharpe_ratio)), 0) AS best, {seen} FROM met GROUP BY symbol),
  pt AS MATERIALIZED (SELECT p, {drawn} FROM range({n_iter * samples}) t(p)),
  g0 AS MATERIALIZED (SELECT symbol, p, u0, u1, u2, best, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS var, {first} FROM kn, pt)"""]
    for k in range(n):
        less = lambda i: f"a{k}_{i} / a{k}_{k}"
        rest = range(k + 1, n)
        left = [*(f"a{i}_{j} - {less(i)} * a{k}_{j} AS a{i}_{j}" for i in rest for j in range(i, n)),
                *(f"c{i} - {less(i)} * c{k} AS c{i}" for i in rest), *(f"y{i} - {less(i)} * y{k} AS y{i}" for i in rest)]
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT " + ", ".join(["symbol, p, u0, u1, u2, best", f"mean + c{k} * y{k} / a{k}_{k} AS mean", f"var - c{k} * c{k} / a{k}_{k} AS var", *left]) + f" FROM g{k})")
    steps.append(f"gp AS MATERIALIZED (SELECT symbol, p, u0, u1, u2, best, mean, sqrt(greatest(var, 1e-10::DOUBLE)) AS dev FROM g{n})")
    return ",\n  ".join(steps)


# the distribution function as a series of positive terms within four deviations, a continued fraction in the tails
BELOW = """zs AS MATERIALIZED (SELECT *, mean - best - 0.01::DOUBLE AS over, over / (dev + 1e-10::DOUBLE) AS z FROM gp),
  zt AS MATERIALIZED (SELECT *, greatest(abs(z), 4.0::DOUBLE) AS far, exp(-far * far / 2) / sqrt(2 * pi()) / list_reduce(
    list_prepend(far, list_transform(range(80), lambda n: (80 - n)::DOUBLE)), lambda f, n: far + n / f) AS tail FROM zs),
  zp AS MATERIALIZED (SELECT *, CASE WHEN z >= 4 THEN 1 - tail WHEN z <= -4 THEN tail ELSE 0.5::DOUBLE * (1 + sign(z) * exp(-z * z / 2) *
    list_sum(list_transform(range(80), lambda n: power(abs(z) / sqrt(2.0::DOUBLE), 2 * n + 1) / gamma(n + 1.5::DOUBLE)))) END AS below FROM zt)"""
GAINS = {
    "ei": "over * below + dev * exp(-0.5::DOUBLE * z * z) / sqrt(2 * pi())", "poi": "below",
    "ucb": "mean + 2.576::DOUBLE * dev",
}


def suggest_sql(kind: str) -> str:
    return with_(f"{OBJ}, {posterior_sql(8, 5, 100, 1)}, {BELOW}, gn AS (SELECT *, p // 100 AS slot, {GAINS[kind]} AS gain FROM zp)",
                 f"""SELECT symbol, slot, {r('gain', None, 6)}, {r('12 + u0 * 36', 'min_trend_period_hours', 6)}, CAST(floor(7 + u1 * 21) AS INT) AS atr_period, CAST(floor(1 + u2 * 2) AS INT) AS slope_lookback
  FROM gn QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY gn.gain DESC, p) = 1""")


def suggested(spark, sf, kind):
    seen = grid_run(spark, sf).withColumn("score", F.col("sharpe_ratio"))
    return rounded(so.suggest(seen, SPACE, SERIES, n_iter=5, seed=1, kind=kind).drop("interval"), 6)


@query("o3_gp_acquisition", suggest_sql("ei"))
def o3(spark, sf):
    return suggested(spark, sf, "ei")


@query("o3_gp_confidence_bound", suggest_sql("ucb"))
def o3_ucb(spark, sf):
    return suggested(spark, sf, "ucb")


@query("o3_gp_improvement_chance", suggest_sql("poi"))
def o3_poi(spark, sf):
    return suggested(spark, sf, "poi")


def drawn_at(i: int) -> list[str]:
    """Coordinates of the i-th random candidate; whole numbers lie where their value does."""
    u = [uniform_sql(str(i), str(d), 1) for d in range(3)]
    return [u[0], f"floor({u[1]} * 22) / 21.0::DOUBLE", f"floor({u[2]} * 3) / 2.0::DOUBLE"]


# the start, its posterior at drawn points, the best of each slot, and the scores of those
NEXT_SQL = f"""nx AS MATERIALIZED (SELECT symbol, 4 + p // 100 AS param_id, 12 + u0 * 36 AS hours, floor(7 + u1 * 21) AS period, CAST(floor(1 + u2 * 2) AS INT) AS lookback
    FROM (SELECT *, p // 100 AS slot, {GAINS['ei']} AS gain FROM zp) QUALIFY row_number() OVER (PARTITION BY symbol, slot ORDER BY gain DESC, p) = 1),
  pn AS (SELECT tr0.*, nx.* EXCLUDE (symbol) FROM tr0 JOIN nx USING (symbol))"""
O4_NAMES = f"{r('hours', 'min_trend_period_hours', 6)}, period::INT AS atr_period, lookback AS slope_lookback, {r('sharpe_ratio', None, 6)}"


@query("o4_bayesian_search", with_(
    f"{TR}, {random_sql(1)}, {PB}, {objective_sql()}, {posterior_sql(4, 4, 100, 1, drawn_at)}, {BELOW}, {NEXT_SQL}, {objective_sql('pn', p='n_')}",
    f"""SELECT symbol, param_id, {O4_NAMES} FROM met JOIN par USING (param_id)
  UNION ALL SELECT symbol, param_id, {O4_NAMES} FROM n_met JOIN nx USING (symbol, param_id)"""))
def o4(spark, sf):
    spec = op.Search(SPACE, "bayesian", n=4, n_initial=4, seed=1)
    return rounded(op.search(prepared(spark, sf), spec).select("symbol", "param_id", *NAMES, "sharpe_ratio"), 6)


# --- walk-forward -------------------------------------------------------------------------------

TRAIN, TEST, STEP = 220, 110, 160
WIN = f"""wn AS (SELECT symbol, s // {STEP} AS window_id, s AS train_start, s + {TRAIN} AS train_end, s + {TRAIN} AS test_start, s + {TRAIN + TEST} AS test_end
  FROM (SELECT symbol, unnest(range(0, n_bars - {TRAIN + TEST} + 1, {STEP})) AS s FROM ib WHERE bar_idx = 0))"""


@query("o9_walkforward_windows", with_(f"{HOURLY}, {WIN}", f"""SELECT 'rolling' AS kind, * FROM wn
  UNION ALL SELECT 'anchored', symbol, window_id, 0, train_end, test_start, test_end FROM wn"""))
def o9(spark, sf):
    lengths = indexed(spark, sf).where("bar_idx = 0").select("symbol", "n_bars")
    rolling = op.walk_windows(lengths, TRAIN, TEST, STEP).withColumn("kind", F.lit("rolling"))
    anchored = op.walk_windows(lengths, TRAIN, TEST, STEP, anchored=True).withColumn("kind", F.lit("anchored"))
    return rolling.unionByName(anchored)


@query("j6_bars_in_windows", with_(f"{HOURLY}, {WIN}", f"SELECT symbol, window_id, bar_idx, {rs('close')} FROM ib JOIN wn USING (symbol) WHERE bar_idx >= train_start AND bar_idx < train_end"))
def j6(spark, sf):
    d = indexed(spark, sf)
    w = op.walk_windows(d.where("bar_idx = 0").select(*SERIES, "n_bars"), TRAIN, TEST, STEP)
    return rounded(align.in_windows(d, w, "train_start", "train_end").select("symbol", "window_id", "bar_idx", "close"))


@query("o10_train_test_split", with_(f"{HOURLY}, {WIN}", f"""SELECT 'train' AS part, symbol, window_id, bar_idx - train_start AS bar_idx, {rs('close')} FROM ib JOIN wn USING (symbol)
  WHERE bar_idx >= train_start AND bar_idx < train_end UNION ALL SELECT 'test', symbol, window_id, bar_idx - test_start, {rs('close')} FROM ib JOIN wn USING (symbol)
  WHERE bar_idx >= test_start AND bar_idx < test_end"""))
def o10(spark, sf):
    d = prepared(spark, sf)
    w = op.walk_windows(d.where("bar_idx = 0").select(*SERIES, "n_bars"), TRAIN, TEST, STEP)
    part = lambda p: op.window_bars(d, w, p).withColumn("part", F.lit(p)).select("part", "symbol", "window_id", "bar_idx", "close")
    return rounded(part("train").unionByName(part("test")))


def cut_sql(part: str, extra: str = "", join: str = "") -> str:
    size = TRAIN if part == "train" else TEST
    return f"""SELECT t.symbol, wn.window_id, t.bar_idx - wn.{part}_start AS bar_idx, {size} AS n_bars, t.open_time, t.open, t.high, t.low, t.close,
  CASE WHEN t.bar_idx = wn.{part}_start THEN t.high - t.low ELSE t.tr END AS tr{extra}
  FROM tr0 t JOIN wn ON wn.symbol = t.symbol AND t.bar_idx >= wn.{part}_start AND t.bar_idx < wn.{part}_end {join}"""


WF = f"""{TR}, {WIN}, {RANDOM_SQL}, ptrain AS ({cut_sql('train', ', par.*', ', par')}), {objective_sql('ptrain', 'symbol, window_id, param_id', 'a')},
  chosen AS (SELECT * FROM amet QUALIFY row_number() OVER (PARTITION BY symbol, window_id ORDER BY sharpe_ratio DESC, param_id) = 1),
  ptest AS ({cut_sql('test', ', par.hours, par.period, par.lookback', 'JOIN chosen c ON c.symbol = t.symbol AND c.window_id = wn.window_id JOIN par USING (param_id)')}),
  {objective_sql('ptest', 'symbol, window_id', 'b')}"""


def walk(spark, sf):
    return op.walk_forward(prepared(spark, sf), RANDOM, TRAIN, TEST, STEP)


OOS = [m for m in METRIC_NAMES.split() if m != "annualized_return"] + ["n_trades", "n_wins", "n_losses"]


# annualised returns of these prices run to 1e147, so their logarithm is compared
@query("o11_walk_forward_oos", with_(WF, f"SELECT symbol, {r('log10(1 + avg(annualized_return))', 'annualized_log10', 6)}, {', '.join(r(f'avg({m})', m, 6) for m in OOS)} FROM bmet GROUP BY symbol"))
def o11(spark, sf):
    out = walk(spark, sf).out_of_sample.withColumn("annualized_log10", F.log10(1 + F.col("annualized_return")))
    return rounded(out.drop("interval", "annualized_return"), 6)


@query("o17_train_vs_test", with_(WF, f"SELECT symbol, window_id, {r('c.sharpe_ratio', 'train', 6)}, {r('b.sharpe_ratio', 'test', 6)} FROM chosen c JOIN bmet b USING (symbol, window_id)"))
def o17(spark, sf):
    return rounded(op.train_vs_test(walk(spark, sf), "sharpe_ratio").drop("interval"), 6)


@query("o12_combined_oos", with_(f"""{ACCOUNT}, cur AS (SELECT symbol, bar_idx // 100 AS window_id, bar_idx % 100 AS i, equity, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS n FROM acc),
  q AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY n) - 1 AS ret, max(equity) OVER (PARTITION BY symbol ORDER BY n) AS peak FROM cur)""",
  f"""SELECT symbol, {r('(arg_max(equity, n) - arg_min(equity, n)) / arg_min(equity, n)', 'total_return', 6)}, {r('arg_max(equity, n) / arg_min(equity, n) - 1', 'cumulative_return', 6)},
  {r('power(arg_max(equity, n) / arg_min(equity, n), 8760.0::DOUBLE / count(*)) - 1', 'annualized_return', 6)},
  {r('avg(ret) / (stddev_samp(ret) + 1e-10) * sqrt(8760)', 'sharpe_ratio', 6)},
  {r('avg(ret) / ((stddev_samp(ret) FILTER (WHERE ret < 0)) + 1e-10) * sqrt(8760)', 'sortino_ratio', 6)},
  {r('min(equity - peak)', 'max_drawdown', 6)}, {r('arg_min((equity - peak) / peak, (equity - peak, n))', 'max_drawdown_pct', 6)}, count(DISTINCT window_id) AS n_windows FROM q GROUP BY symbol"""))
def o12(spark, sf):
    pos = flagship(spark, sf)[0]
    curves = pos.select(*SERIES, F.floor(F.col("bar_idx") / 100).alias("window_id"), (F.col("bar_idx") % 100).alias("bar_idx"), "equity", "ret")
    return rounded(op.combined_curve_metrics(curves).drop("interval"), 6)


IMP = f"""{OBJ}, lb AS (SELECT symbol, param_id, hours, period, lookback, sharpe_ratio FROM met JOIN par USING (param_id)),
  im AS (SELECT symbol, 'min_trend_period_hours' AS parameter, abs(corr(hours, sharpe_ratio)) AS importance FROM lb GROUP BY symbol
    UNION ALL SELECT symbol, 'atr_period', abs(corr(period, sharpe_ratio)) FROM lb GROUP BY symbol
    UNION ALL SELECT symbol, 'slope_lookback', abs(corr(lookback, sharpe_ratio)) FROM lb GROUP BY symbol)"""


@query("o13_parameter_importance", with_(IMP, f"SELECT symbol, parameter, {r('importance', None, 5)} FROM im WHERE importance IS NOT NULL"))
def o13(spark, sf):
    imp = so.parameter_importance(board_of(spark, sf), NAMES, "train_sharpe_ratio", SERIES)
    return rounded(imp.select("symbol", "parameter", "importance"), 5)


@query("o14_parameter_heatmap", with_(OBJ, f"""SELECT symbol, lookback AS slope_lookback, {r('avg(sharpe_ratio) FILTER (WHERE hours = 12)', '"12.0"', 6)},
  {r('avg(sharpe_ratio) FILTER (WHERE hours = 48)', '"48.0"', 6)} FROM met JOIN par USING (param_id) GROUP BY symbol, lookback"""))
def o14(spark, sf):
    heat = so.parameter_heatmap(board_of(spark, sf), "min_trend_period_hours", "slope_lookback", "train_sharpe_ratio", SERIES, [12.0, 48.0])
    heat = heat.toDF(*[c.replace(".", "_") for c in heat.columns])
    return rounded(heat.drop("interval"), 6).withColumnsRenamed({"12_0": "12.0", "48_0": "48.0"})


@query("o15_best_so_far", with_(OBJ, f"SELECT symbol, param_id, {r('sharpe_ratio', None, 6)}, {r('max(sharpe_ratio) OVER (PARTITION BY symbol ORDER BY param_id)', 'best', 6)} FROM met"))
def o15(spark, sf):
    return rounded(so.best_so_far(grid_run(spark, sf), "sharpe_ratio", SERIES).drop("interval"), 6)


@query("o16_metric_frontier", with_(OBJ, f"SELECT symbol, param_id, {r('sharpe_ratio', 'x', 6)}, {r('max_drawdown_pct', 'y', 6)} FROM met"))
def o16(spark, sf):
    return rounded(so.frontier(board_of(spark, sf), "train_sharpe_ratio", "train_max_drawdown_pct", SERIES).drop("interval"), 6)


# --- Monte Carlo --------------------------------------------------------------------------------

SIMS, BLOCK, SEED = 40, 20, 5
# Close-to-close hourly returns, damped so that compounding stays in range.
RET = f"""{HOURLY}, rt AS (SELECT symbol, bar_idx - 1 AS idx, (close - pc) / (close + pc + 1) / 50 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS pc FROM ib) WHERE pc IS NOT NULL)"""
BOOT = f"""{RET}, ln AS (SELECT symbol, count(*) AS n, CAST(ceil(count(*) / {BLOCK}.0) AS BIGINT) AS nb FROM rt GROUP BY symbol),
  dr AS (SELECT symbol, n, sim_id, blk, {hash_sql('sim_id * nb + blk', '0', SEED)} % greatest(1, n - {BLOCK} + 1) AS start
    FROM ln, range({SIMS}) t(sim_id), LATERAL (SELECT unnest(range(nb)) AS blk) b),
  bs AS (SELECT d.symbol, d.sim_id, d.blk * {BLOCK} + o AS pos, rt.ret FROM dr d, range({BLOCK}) t(o), rt WHERE rt.symbol = d.symbol AND rt.idx = d.start + o AND d.blk * {BLOCK} + o < d.n)"""


def damped_returns(spark, sf):
    from tidemark.operators.series import chunk_window, drop_halo, lay_out

    d = lay_out(indexed(spark, sf), back=1)
    before = F.lag("close").over(chunk_window())
    d = drop_halo(d.withColumn("_pc", before)).where(F.col("_pc").isNotNull())
    ret = (F.col("close") - F.col("_pc")) / (F.col("close") + F.col("_pc") + 1) / 50
    return d.select(*SERIES, (F.col("bar_idx") - 1).alias("idx"), ret.alias("ret"))


def boot(spark, sf):
    return mc.block_bootstrap(damped_returns(spark, sf), "ret", SIMS, BLOCK, SEED)


@query("m1_block_bootstrap", with_(BOOT, f"SELECT symbol, sim_id, pos, {rs('ret')} FROM bs"))
def m1(spark, sf):
    return rounded(boot(spark, sf).drop("interval"))


@query("m2_residual_bootstrap", with_(f"""{SMOOTHED}, ln AS (SELECT symbol, count(*) AS n, CAST(ceil(count(*) / 30.0) AS BIGINT) AS nb FROM sm GROUP BY symbol),
  dr AS (SELECT symbol, n, sim_id, blk, {hash_sql('sim_id * nb + blk', '0', 9)} % greatest(1, n - 30 + 1) AS start FROM ln, range(10) t(sim_id), LATERAL (SELECT unnest(range(nb)) AS blk) b)""",
  f"""SELECT d.symbol, d.sim_id, d.blk * 30 + o AS pos, {r('l.smoothed + s.close - s.smoothed', 'price', 6)} FROM dr d, range(30) t(o), sm s, sm l
  WHERE s.symbol = d.symbol AND s.bar_idx = d.start + o AND l.symbol = d.symbol AND l.bar_idx = d.blk * 30 + o AND d.blk * 30 + o < d.n"""))
def m2(spark, sf):
    return rounded(mc.residual_bootstrap(smoothed(spark, sf), 10, 30, 9).drop("interval"), 6)


CURVES = f"""{BOOT}, cv AS (SELECT symbol, sim_id, pos, ret, 10000 * product(1 + ret) OVER (PARTITION BY symbol, sim_id ORDER BY pos) AS equity FROM bs)"""


@query("m3_simulated_equity", with_(CURVES, f"SELECT symbol, sim_id, pos + 1 AS bar_idx, {rs('equity')} FROM cv UNION ALL SELECT DISTINCT symbol, sim_id, 0, 10000.0 FROM cv"))
def m3(spark, sf):
    return rounded(mc.simulated_curves(boot(spark, sf), 10000.0).select("symbol", "sim_id", "bar_idx", "equity"))


SIMM = f"""{CURVES}, dd AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY symbol, sim_id ORDER BY pos)) AS peak FROM cv),
  ms AS (SELECT symbol, sim_id, (arg_max(equity, pos) - 10000) / 10000 AS total_return, avg(ret) / (stddev_samp(ret) + 1e-10) * sqrt(8760) AS sharpe_ratio,
    avg(ret) / ((stddev_samp(ret) FILTER (WHERE ret < 0)) + 1e-10) * sqrt(8760) AS sortino_ratio, arg_min((equity - peak) / peak, (equity - peak, pos)) AS max_drawdown_pct,
    power(arg_max(equity, pos) / 10000, 8760.0::DOUBLE / (count(*) + 1)) - 1 AS annualized_return FROM dd GROUP BY symbol, sim_id),
  ml AS (UNPIVOT ms ON total_return, sharpe_ratio, sortino_ratio, max_drawdown_pct, annualized_return INTO NAME metric VALUE value)"""


def sim_metrics(spark, sf):
    return mc.bootstrap_metrics(damped_returns(spark, sf), 10000.0, n_sims=SIMS, block=BLOCK, seed=SEED)


M4_SELECT = f"SELECT symbol, sim_id, {rs('total_return sharpe_ratio sortino_ratio max_drawdown_pct annualized_return', 6)} FROM ms"


@query("m4_curve_metrics", with_(SIMM, M4_SELECT))
def m4_curves(spark, sf):
    return rounded(mc.curve_metrics(boot(spark, sf), 10000.0).drop("interval"), 6)


@query("m4_simulation_metrics", with_(SIMM, f"SELECT symbol, sim_id, {rs('total_return sharpe_ratio sortino_ratio max_drawdown_pct annualized_return', 6)} FROM ms"))
def m4(spark, sf):
    return rounded(sim_metrics(spark, sf).drop("interval"), 6)


@query("m4_percentiles", with_(SIMM, f"""SELECT symbol, metric, {', '.join(r(f'quantile_cont(value, {p / 100})', f'p{p}', 6) for p in (5, 25, 50, 75, 95))},
  {r('avg(value)', 'mean', 6)}, {r('stddev_samp(value)', 'std', 6)} FROM ml GROUP BY symbol, metric"""))
def m4_percentiles(spark, sf):
    return rounded(mc.summarise(sim_metrics(spark, sf)).drop("interval"), 6)


@query("m5_histogram", with_(SIMM, """SELECT symbol, metric, CAST(least(9, floor((value - lo) / (hi - lo) * 10)) AS BIGINT) AS bin, count(*) AS n
  FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM ml WINDOW w AS (PARTITION BY symbol, metric)) GROUP BY ALL"""))
def m5(spark, sf):
    return mc.histogram(sim_metrics(spark, sf), 10).drop("interval")


# --- sinks: written, read back and returned -----------------------------------------------------

def _out(spark) -> str:
    return fresh_folder(spark, "sink")


@query("a11_leaderboard_sink", with_(OBJ, f"SELECT 'csv' AS fmt, symbol, param_id, {r('sharpe_ratio', 'train_sharpe_ratio', 6)} FROM met UNION ALL SELECT 'parquet', symbol, param_id, {r('sharpe_ratio', 'train_sharpe_ratio', 6)} FROM met"))
def a11(spark, sf):
    board, path = stage(board_of(spark, sf)), _out(spark)
    sinks.write_leaderboard(board, f"{path}/c", "csv")
    sinks.write_leaderboard(board, f"{path}/p", "parquet")
    csv = spark.read.option("header", True).schema(board.schema).csv(f"{path}/c").withColumn("fmt", F.lit("csv"))
    parquet = spark.read.parquet(f"{path}/p").withColumn("fmt", F.lit("parquet"))
    return rounded(csv.unionByName(parquet).select("fmt", "symbol", "param_id", "train_sharpe_ratio"), 6)


@query("a12_best_config_json", with_(f"{OBJ}, {BEST}", f"""SELECT symbol, 'grid_search' AS method, {r('sharpe_ratio', 'best_score', 6)}, hours AS min_trend_period_hours,
  lookback AS slope_lookback FROM best JOIN par USING (param_id)"""))
def a12(spark, sf):
    path = _out(spark) + "/best"
    sinks.write_best_config(grid_run(spark, sf), path, NAMES, "grid_search", "sharpe_ratio", 0)
    doc = F.from_json("value", "method string, objective_metric string, best_score double, seed bigint, best_params struct<min_trend_period_hours: double, atr_period: int, slope_lookback: int>")
    back = spark.read.option("basePath", path).text(path).withColumn("d", doc)
    return rounded(back.select("symbol", "d.method", "d.best_score", "d.best_params.min_trend_period_hours", "d.best_params.slope_lookback"), 6)


@query("a13_walkforward_sink", with_(f"{HOURLY}, {WIN}", "SELECT symbol, window_id, train_start, train_end, test_start, test_end FROM wn"))
def a13(spark, sf):
    path = _out(spark)
    sinks.write_walk_forward(walk(spark, sf), path)
    schema = "symbol string, interval string, window_id long, train_start long, train_end long, test_start long, test_end long"
    return spark.read.option("header", True).schema(schema).csv(f"{path}/windows").drop("interval")


@query("a14_monte_carlo_sink", with_(SIMM, f"SELECT symbol, metric, sim_id, {r('value', None, 6)} FROM ml"))
def a14(spark, sf):
    path = _out(spark)
    sinks.write_monte_carlo(stage(sim_metrics(spark, sf)), path)
    back = spark.read.option("header", True).schema("symbol string, interval string, sim_id long, value double, metric string").csv(f"{path}/distribution")
    return rounded(back.drop("interval"), 6)


@query("a14_monte_carlo_summary", with_(SIMM, f"""SELECT symbol, metric, {', '.join(r(f'quantile_cont(value, {p / 100})', f'p{p}', 6) for p in (5, 25, 50, 75, 95))},
  {r('avg(value)', 'mean', 6)}, {r('stddev_samp(value)', 'std', 6)} FROM ml GROUP BY symbol, metric"""))
def a14_summary(spark, sf):
    path = _out(spark)
    sinks.write_monte_carlo(stage(sim_metrics(spark, sf)), path)
    numbers = "p5 double, p25 double, p50 double, p75 double, p95 double, mean double, std double"
    return rounded(spark.read.schema(f"symbol string, metric string, {numbers}").json(f"{path}/summary"), 6)


@query("a13_walkforward_test_metrics", with_(WF, f"SELECT symbol, window_id, n_trades, {rs('sharpe_ratio total_return win_rate', 6)} FROM bmet"))
def a13_test(spark, sf):
    path = _out(spark)
    sinks.write_walk_forward(walk(spark, sf), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/test_metrics")
    return rounded(back.select("symbol", F.col("window_id").cast("long").alias("window_id"), F.col("n_trades").cast("long").alias("n_trades"),
                               *[F.col(c).cast("double").alias(c) for c in ("sharpe_ratio", "total_return", "win_rate")]), 6)


@query("a13_walkforward_train", with_(WF, f"""SELECT symbol, window_id, {r('hours', 'min_trend_period_hours', 6)}, CAST(period AS BIGINT) AS atr_period, CAST(lookback AS BIGINT) AS slope_lookback,
  {rs('sharpe_ratio total_return', 6)}, n_trades FROM chosen JOIN par USING (param_id)"""))
def a13_train(spark, sf):
    """Training metrics and the chosen parameters, each read back from its own file."""
    path = _out(spark)
    sinks.write_walk_forward(walk(spark, sf), path)
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}")
    train = read("train_metrics").select("symbol", "window_id", "sharpe_ratio", "total_return", "n_trades")
    best = read("best_params_per_window").select("symbol", "window_id", "min_trend_period_hours", "atr_period", "slope_lookback")
    both = train.join(best, ["symbol", "window_id"]).withColumns({c: F.col(c).cast("long") for c in ("window_id", "n_trades", "atr_period", "slope_lookback")})
    return rounded(both, 6)


@query("a13_walkforward_combined", with_(WF, f"SELECT symbol, {', '.join(r(f'avg({m})', m, 6) for m in ('sharpe_ratio', 'win_rate', 'n_trades'))} FROM bmet GROUP BY symbol"))
def a13_combined(spark, sf):
    """The combined out-of-sample metrics, read back from JSON."""
    path = _out(spark)
    sinks.write_walk_forward(walk(spark, sf), path)
    return rounded(spark.read.schema("symbol string, sharpe_ratio double, win_rate double, n_trades double").json(f"{path}/combined_oos_metrics"), 6)


@query("a15_full_export_csv", with_(OBJ, f"SELECT symbol, param_id, {r('sharpe_ratio', 'train_sharpe_ratio', 6)}, hours AS min_trend_period_hours, period AS atr_period, lookback AS slope_lookback FROM met JOIN par USING (param_id)"))
def a15_csv(spark, sf):
    """Every row of the exported leaderboard CSV."""
    path, results = _out(spark), stage(grid_run(spark, sf))
    board = so.leaderboard(results, NAMES, ["sharpe_ratio"], "sharpe_ratio", SERIES)
    sinks.write_search(results, board, path, NAMES, "grid_search", "sharpe_ratio", 0)
    csv = spark.read.option("header", True).schema(board.schema).csv(f"{path}/leaderboard_csv")
    return rounded(csv.select("symbol", "param_id", "train_sharpe_ratio", *NAMES), 6)


@query("a15_full_export_config", with_(f"{OBJ}, {BEST}", f"""SELECT symbol, {r('sharpe_ratio', 'best_score', 6)}, lookback AS slope_lookback, (SELECT count(*) FROM met) AS csv_rows
  FROM best JOIN par USING (param_id)"""))
def a15_config(spark, sf):
    path, results = _out(spark), stage(grid_run(spark, sf))
    board = so.leaderboard(results, NAMES, ["sharpe_ratio"], "sharpe_ratio", SERIES)
    sinks.write_search(results, board, path, NAMES, "grid_search", "sharpe_ratio", 0)
    csv = spark.read.option("header", True).csv(f"{path}/leaderboard_csv").agg(F.count("*").alias("csv_rows"))
    doc = F.from_json("value", "best_score double, best_params struct<slope_lookback: int>").alias("d")
    best = spark.read.option("basePath", f"{path}/best_config").text(f"{path}/best_config").select("symbol", doc)
    return rounded(best.select("symbol", "d.best_score", "d.best_params.slope_lookback", csv.select("csv_rows").scalar().alias("csv_rows")), 6)


@query("a15_full_export", with_(OBJ, f"SELECT symbol, param_id, {r('sharpe_ratio', 'train_sharpe_ratio', 6)} FROM met"))
def a15(spark, sf):
    path, results = _out(spark), stage(grid_run(spark, sf))
    board = so.leaderboard(results, NAMES, ["sharpe_ratio"], "sharpe_ratio", SERIES)
    sinks.write_search(results, board, path, NAMES, "grid_search", "sharpe_ratio", 0)
    return rounded(spark.read.parquet(f"{path}/leaderboard_parquet").select("symbol", "param_id", "train_sharpe_ratio"), 6)
