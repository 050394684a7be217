"""Portfolio operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog.base import ACCOUNT, query, r, rounded, rs, table, with_
from catalog.backtests import MET, flagship
from catalog.signals import COMMON, DRET, common_returns, daily_returns
from tidemark.operators import portfolio as pf
from tidemark.operators.rebalance import accept_targets
from tidemark.plans.portfolio_run import Policy, run_portfolio
from tidemark.plans.staging import stage

RX = f"""{COMMON}, rx AS (SELECT symbol, bar_idx AS t, coalesce(ret / (2 + ret) / 50, 0) AS ret FROM common)"""


def member_returns(spark, sf):
    """Damped daily returns of the regions on their common days; the first return counts as zero."""
    d = common_returns(spark, sf)
    return stage(d.select(F.lit("all").alias("portfolio"), "symbol", F.col("bar_idx").alias("t"), F.coalesce(F.col("ret") / (2 + F.col("ret")) / 50, F.lit(0.0)).alias("ret")))


@query("p1_symbol_backtests", with_(f"{ACCOUNT}, q AS (SELECT symbol, bar_idx, equity, coalesce(equity / lag(equity) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1, 0) AS ret FROM acc)",
  f"SELECT symbol, bar_idx, {rs('equity ret')} FROM q"))
def p1(spark, sf):
    return rounded(flagship(spark, sf)[0].select("symbol", "bar_idx", "equity", F.coalesce("ret", F.lit(0.0)).alias("ret")))


@query("p2_symbol_statistics", with_(MET, f"SELECT symbol, n_trades, {rs('total_return sharpe_ratio max_drawdown_pct win_rate profit_factor')} FROM met"))
def p2(spark, sf):
    return rounded(flagship(spark, sf)[2].select("symbol", "n_trades", "total_return", "sharpe_ratio", "max_drawdown_pct", "win_rate", "profit_factor"))


MEMBERS = "mb AS (SELECT DISTINCT symbol FROM rx)"


@query("p3_equal_weights", with_(f"{RX}, {MEMBERS}", "SELECT symbol, round(1.0::DOUBLE / (SELECT count(*) FROM mb), 7) AS weight FROM mb"))
def p3(spark, sf):
    return rounded(pf.equal_weights(member_returns(spark, sf)).drop("portfolio"))


VOLW = """sd AS (SELECT symbol, stddev_samp(ret) AS sd FROM rx WHERE t > (SELECT max(t) FROM rx) - 60 GROUP BY symbol),
  iv AS (SELECT symbol, 1 / sd / sum(1 / sd) OVER () AS w FROM sd), cw AS (SELECT symbol, least(greatest(w, 0.18), 0.21) AS w FROM iv),
  vw AS (SELECT symbol, w / sum(w) OVER () AS weight FROM cw)"""


@query("p4_inverse_volatility", with_(f"{RX}, {VOLW}", f"SELECT symbol, {rs('weight')} FROM vw"))
def p4(spark, sf):
    return rounded(pf.inverse_volatility_weights(member_returns(spark, sf), 60, 0.18, 0.21).drop("portfolio"))


# Undamped steps on a near-uncorrelated sample (trap: they need not converge), replayed for 100 rounds.
RISK = """cv AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) AS v FROM rx a JOIN rx b USING (t)
    WHERE a.t > (SELECT max(t) FROM rx) - 60 GROUP BY ALL),
  rp AS (SELECT 0 AS n, map_from_entries(list((i, 0.2::DOUBLE))) AS w, false AS done FROM (SELECT DISTINCT i FROM cv)
    UNION ALL SELECT s.n + 1, map_from_entries(list((s.i, s.nw / s.tot))), max(abs(s.nw / s.tot - s.w0)) < 1e-6 FROM (
      SELECT n, i, w0, nw, sum(nw) OVER () AS tot FROM (
        SELECT n, i, w0, least(greatest(w0 * (pv / 5 / greatest(rc, 1e-10)), 0), 1) AS nw FROM (
          SELECT n, i, w0, rc, sum(rc) OVER () AS pv FROM (SELECT rp.n, cv.i, any_value(rp.w[cv.i]) AS w0, sum(rp.w[cv.i] * cv.v * rp.w[cv.j]) AS rc
            FROM rp, cv WHERE rp.n < 100 AND NOT rp.done GROUP BY rp.n, cv.i)))) s GROUP BY s.n),
  fin AS (SELECT w FROM rp ORDER BY n DESC LIMIT 1)"""


@query("p5_risk_parity_reference", with_(f"{RX}, {RISK}", f"SELECT mb.symbol, {r('fin.w[mb.symbol]', 'weight', 5)} FROM fin, (SELECT DISTINCT symbol FROM rx) mb"))
def p5_reference(spark, sf):
    return rounded(pf.risk_parity_weights(member_returns(spark, sf), 60, method="reference").drop("portfolio"), 5)


# The invariant of damped risk parity: every member contributes the same share of variance.
@query("p5_risk_parity_damped", with_(f"{RX}, {MEMBERS}", "SELECT symbol, 0.2::DOUBLE AS share FROM mb"))
def p5_damped(spark, sf):
    rets = member_returns(spark, sf)
    w = stage(pf.risk_parity_weights(rets, 60))
    rc = pf.risk_contributions(w, pf.covariance(pf.last_rows(rets, 60)))
    total = rc.groupBy("portfolio").agg(F.sum("contribution").alias("v"))
    return rc.join(total, "portfolio").select("symbol", F.round(F.col("contribution") / F.col("v"), 4).alias("share"))


CAPS = """cp AS (SELECT r_name AS symbol, greatest(sum(s_acctbal), 1.0) AS cap FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1)"""


def caps(spark, sf, without="ASIA"):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name") != without)
    return s.groupBy(F.col("r_name").alias("symbol")).agg(F.greatest(F.sum("s_acctbal"), F.lit(1.0)).alias("cap"))


@query("p6_weight_caps", with_(CAPS.replace("r_name <> 'ASIA'", "true") + ", w AS (SELECT symbol, least(greatest(cap / sum(cap) OVER (), 0.15), 0.22) AS c FROM cp)", f"SELECT symbol, {r('c / sum(c) OVER ()', 'weight')} FROM w"))
def p6(spark, sf):
    c = caps(spark, sf, without="").withColumn("portfolio", F.lit("all"))
    total = c.groupBy("portfolio").agg(F.sum("cap").alias("v"))
    raw = c.join(total, "portfolio").select("portfolio", "symbol", (F.col("cap") / F.col("v")).alias("weight"))
    return rounded(pf.cap_weights(raw, 0.15, 0.22).select("symbol", "weight"))


MCW = f"""{RX}, {CAPS}, {MEMBERS}, w0 AS (SELECT symbol, coalesce(cap, 1.0) / sum(coalesce(cap, 1.0)) OVER () AS w FROM mb LEFT JOIN cp USING (symbol)),
  mw AS (SELECT symbol, least(w, 0.4) / sum(least(w, 0.4)) OVER () AS weight FROM w0)"""


@query("p7_market_cap_weights", with_(MCW, f"SELECT symbol, {rs('weight')} FROM mw"))
def p7(spark, sf):
    members = member_returns(spark, sf).select("portfolio", "symbol").distinct()
    return rounded(pf.market_cap_weights(members, caps(spark, sf), 0.0, 0.4).drop("portfolio"))


FREQ, LOOK, THR = 24, 60, 0.02
TARGETS = f"""{RX}, ck AS (SELECT unnest(range(0, (SELECT max(t) FROM rx) + 1, {FREQ})) AS c),
  seen AS (SELECT c, symbol, stddev_samp(ret) AS sd FROM ck JOIN rx ON (c > 0 AND t >= c - {LOOK} AND t < c) OR (c = 0 AND t > (SELECT max(t) FROM rx) - {LOOK}) GROUP BY c, symbol),
  tg AS (SELECT c, symbol, 1 / sd / sum(1 / sd) OVER (PARTITION BY c) AS w FROM seen),
  tl AS (SELECT c, list(w ORDER BY symbol) AS w FROM tg GROUP BY c),
  ch AS (SELECT c, w, true AS taken FROM tl WHERE c = 0 UNION ALL SELECT n.c, CASE WHEN x.dev > {THR} THEN n.w ELSE p.w END, x.dev > {THR} FROM ch p JOIN tl n ON n.c = p.c + {FREQ},
    LATERAL (SELECT max(abs(n.w[i] - p.w[i])) AS dev FROM range(1, 6) t(i)) x)"""
POLICY = Policy("volatility", FREQ, THR, lookback=LOOK)


@query("p8_rebalance_chain", with_(TARGETS, f"SELECT c AS \"check\", s.symbol, {r('ch.w[s.pos]', 'weight')} FROM ch, (SELECT symbol, row_number() OVER (ORDER BY symbol) AS pos FROM (SELECT DISTINCT symbol FROM rx)) s WHERE taken"))
def p8(spark, sf):
    targets = pf.target_weights(member_returns(spark, sf), "volatility", FREQ, LOOK)
    return rounded(accept_targets(targets, THR).drop("portfolio"))


@query("p8_rebalance_decision", with_(f"{MCW}, {VOLW}", f"""SELECT symbol, {r('CASE WHEN f THEN v ELSE m END', 'weight')}, f AS rebalanced FROM (
  SELECT symbol, vw.weight AS v, mw.weight AS m, max(abs(vw.weight - mw.weight)) OVER () > 0.05 AS f FROM vw JOIN mw USING (symbol))"""))
def p8_once(spark, sf):
    rets = member_returns(spark, sf)
    now = pf.market_cap_weights(rets.select("portfolio", "symbol").distinct(), caps(spark, sf), 0.0, 0.4)
    return rounded(pf.rebalance(now, pf.inverse_volatility_weights(rets, 60, 0.18, 0.21)).drop("portfolio"))


@query("p9_weight_dispatch", with_(f"{TARGETS}", f"""SELECT 'volatility' AS method, c AS "check", symbol, {r('w', 'weight')} FROM tg
  UNION ALL SELECT 'other', c, symbol, 0.2 FROM seen"""))
def p9(spark, sf):
    rets = member_returns(spark, sf)
    pick = lambda m: pf.target_weights(rets, m, FREQ, LOOK).withColumn("method", F.lit(m)).drop("portfolio")
    return rounded(pick("volatility").unionByName(pick("other")))


SIM = f"""{TARGETS}, sp AS (SELECT c, w, coalesce(lead(c) OVER (ORDER BY c), 1000000) AS nxt FROM ch),
  so AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS pos FROM (SELECT DISTINCT symbol FROM rx)),
  pr AS (SELECT t, CASE WHEN t = 0 THEN 0 ELSE sum(sp.w[so.pos] * rx.ret) END AS ret FROM rx JOIN so USING (symbol) JOIN sp ON t >= sp.c AND t < sp.nxt GROUP BY t),
  pe AS (SELECT t, ret, 10000 * product(1 + ret) OVER (ORDER BY t) AS equity FROM pr)"""


@query("p10_portfolio_simulation", with_(SIM, f"SELECT t AS bar_idx, {rs('ret equity')} FROM pe"))
def p10(spark, sf):
    return rounded(run_portfolio(member_returns(spark, sf), POLICY).equity.drop("portfolio"))


PAIRS = "pp AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, a.t, a.ret AS x, b.ret AS y FROM rx a JOIN rx b ON a.t = b.t AND a.symbol <= b.symbol)"


@query("p11_correlation_pearson", with_(f"{RX}, {PAIRS}", f"SELECT sym_i, sym_j, {r('corr(x, y)', 'corr', 6)} FROM pp GROUP BY ALL"))
def p11(spark, sf):
    return rounded(pf.correlation(member_returns(spark, sf)).drop("portfolio"), 6)


@query("p11_correlation_spearman", with_(f"""{RX}, rk AS (SELECT symbol, t, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0::DOUBLE AS ret FROM rx),
  pp AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, a.ret AS x, b.ret AS y FROM rk a JOIN rk b ON a.t = b.t AND a.symbol <= b.symbol)""",
  f"SELECT sym_i, sym_j, {r('corr(x, y)', 'corr', 6)} FROM pp GROUP BY ALL"))
def p11_spearman(spark, sf):
    return rounded(pf.correlation(member_returns(spark, sf), "spearman").drop("portfolio"), 6)


@query("p11_correlation_kendall", with_(f"""{RX}, {PAIRS}, cd AS (SELECT a.sym_i, a.sym_j, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s,
  count(*) FILTER (WHERE a.x <> b.x) AS nx, count(*) FILTER (WHERE a.y <> b.y) AS ny FROM pp a JOIN pp b ON a.sym_i = b.sym_i AND a.sym_j = b.sym_j AND a.t < b.t GROUP BY ALL)""",
  f"SELECT sym_i, sym_j, {r('s / sqrt(nx::DOUBLE) / sqrt(ny::DOUBLE)', 'corr', 6)} FROM cd"))
def p11_kendall(spark, sf):
    return rounded(pf.correlation(member_returns(spark, sf), "kendall").drop("portfolio"), 6)


# Members that lack bars of their own: every fifth, seventh, ... bar.
RAGGED = f"""{RX}, rg AS (SELECT symbol, t, ret FROM (SELECT *, dense_rank() OVER (ORDER BY symbol) AS m FROM rx) WHERE m = 1 OR m = 2 OR t % (2 * m - 1) <> 0),
  pp AS (SELECT a.symbol AS sym_i, b.symbol AS sym_j, a.t, a.ret AS x, b.ret AS y FROM rg a JOIN rg b ON a.t = b.t AND a.symbol <= b.symbol),
  rk AS (SELECT sym_i, sym_j, rank() OVER (PARTITION BY sym_i, sym_j ORDER BY x) + (count(*) OVER (PARTITION BY sym_i, sym_j, x) - 1) / 2.0::DOUBLE AS x,
    rank() OVER (PARTITION BY sym_i, sym_j ORDER BY y) + (count(*) OVER (PARTITION BY sym_i, sym_j, y) - 1) / 2.0::DOUBLE AS y FROM pp)"""


@query("p11_ragged_members", with_(RAGGED, f"""SELECT sym_i, sym_j, {r('corr', None, 6)}, {r('spearman', None, 6)}, {r('cov', None, 6)} FROM
  (SELECT sym_i, sym_j, corr(x, y) AS corr, covar_samp(x, y) * 1000000 AS cov FROM pp GROUP BY ALL) JOIN (SELECT sym_i, sym_j, corr(x, y) AS spearman FROM rk GROUP BY ALL) USING (sym_i, sym_j)"""))
def p11_ragged(spark, sf):
    d = member_returns(spark, sf)
    number = d.select("symbol").distinct().withColumn("m", F.dense_rank().over(Window.orderBy("symbol")))
    d = stage(d.join(number, "symbol").where("m <= 2 or t % (2 * m - 1) <> 0").drop("m"))
    pair = ["sym_i", "sym_j"]
    rho = pf.correlation(d).select(*pair, "corr").join(pf.correlation(d, "spearman").select(*pair, F.col("corr").alias("spearman")), pair)
    return rounded(rho.join(pf.covariance(d).select(*pair, (F.col("value") * 1000000).alias("cov")), pair), 6)


COV = f"{MCW}, cv AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) AS v FROM rx a JOIN rx b USING (t) GROUP BY ALL), rc AS (SELECT a.symbol, sum(a.weight * b.weight * cv.v) AS c FROM cv JOIN mw a ON a.symbol = i JOIN mw b ON b.symbol = j GROUP BY a.symbol)"


def weighted(spark, sf):
    rets = member_returns(spark, sf)
    w = pf.market_cap_weights(rets.select("portfolio", "symbol").distinct(), caps(spark, sf), 0.0, 0.4)
    return rets, stage(w)


@query("p12_portfolio_volatility", with_(COV, f"SELECT {r('sqrt(sum(c))', 'volatility')} FROM rc"))
def p12(spark, sf):
    rets, w = weighted(spark, sf)
    return rounded(pf.portfolio_volatility(w, pf.covariance(rets)).drop("portfolio"))


@query("p13_diversification_ratio", with_(COV, f"SELECT {r('(SELECT sum(weight * sqrt(v)) FROM mw JOIN cv ON i = symbol AND j = symbol) / sqrt(sum(c))', 'diversification_ratio')} FROM rc"))
def p13(spark, sf):
    rets, w = weighted(spark, sf)
    return rounded(pf.diversification_ratio(w, pf.covariance(rets)).drop("portfolio"))


@query("p14_concentration", with_(MCW, f"""SELECT {r('sum(weight * weight)', 'herfindahl_index')}, {r('1 / sum(weight * weight)', 'effective_n')}, {r('max(weight)', 'max_weight')},
  {r('sum(weight) FILTER (WHERE rk <= 3)', 'top3_concentration')} FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, symbol) AS rk FROM mw)"""))
def p14(spark, sf):
    return rounded(pf.concentration(weighted(spark, sf)[1]).drop("portfolio"))


@query("p15_risk_contributions", with_(COV, f"SELECT symbol, {r('c', 'contribution')} FROM rc"))
def p15(spark, sf):
    rets, w = weighted(spark, sf)
    return rounded(pf.risk_contributions(w, pf.covariance(rets)).drop("portfolio"))


@query("p16_tracking_error", with_(f"{RX}, m AS (SELECT t, avg(ret) AS ret FROM rx GROUP BY t)", f"SELECT symbol, {r('stddev_samp(rx.ret - m.ret) * sqrt(252)', 'tracking_error')} FROM rx JOIN m USING (t) GROUP BY symbol"))
def p16(spark, sf):
    rets = member_returns(spark, sf)
    market = rets.groupBy("t").agg(F.avg("ret").alias("ret"))
    return rounded(pf.tracking_error(rets, market, keys=["symbol"]))


@query("p17_beta", with_(f"{RX}, m AS (SELECT t, avg(ret) AS ret FROM rx GROUP BY t)", f"SELECT symbol, {r('covar_samp(rx.ret, m.ret) / var_samp(m.ret)', 'beta')} FROM rx JOIN m USING (t) GROUP BY symbol"))
def p17(spark, sf):
    rets = member_returns(spark, sf)
    market = rets.groupBy("t").agg(F.avg("ret").alias("ret"))
    return rounded(pf.beta(rets, market, keys=["symbol"]))


@query("p18_portfolio_metrics", with_(f"""{SIM}, fw AS (SELECT so.symbol, (SELECT w FROM ch ORDER BY c DESC LIMIT 1)[so.pos] AS weight FROM so),
  cv AS (SELECT a.symbol AS i, b.symbol AS j, covar_samp(a.ret, b.ret) AS v FROM rx a JOIN rx b USING (t) GROUP BY ALL),
  pv AS (SELECT sqrt(sum(a.weight * b.weight * cv.v)) AS vol FROM cv JOIN fw a ON a.symbol = i JOIN fw b ON b.symbol = j),
  q AS (SELECT *, max(equity) OVER (ORDER BY t) AS peak FROM pe)""", f"""SELECT {r('(arg_max(equity, t) - 10000) / 10000', 'total_return', 6)},
  {r('(stddev_samp(ret) FILTER (WHERE t > 0)) * sqrt(6048)', 'annualized_vol', 6)}, {r('(avg(ret) FILTER (WHERE t > 0)) / (stddev_samp(ret) FILTER (WHERE t > 0)) * sqrt(6048)', 'sharpe_ratio', 6)},
  {r('min(equity - peak)', 'max_drawdown', 6)}, {r('arg_min((equity - peak) / peak, (equity - peak, t))', 'max_drawdown_pct', 6)},
  {r('(SELECT sum(weight * weight) FROM fw)', 'herfindahl_index', 6)}, {r('(SELECT 1 / sum(weight * weight) FROM fw)', 'effective_n_assets', 6)}, {r('(SELECT max(weight) FROM fw)', 'max_weight', 6)},
  {r('(SELECT sum(weight * sqrt(v)) FROM fw JOIN cv ON i = symbol AND j = symbol) / (SELECT vol FROM pv)', 'diversification_ratio', 6)},
  {r('(SELECT vol FROM pv)', 'portfolio_volatility', 6)}, (SELECT count(*) FROM ch WHERE taken) AS n_rebalances FROM q"""))
def p18(spark, sf):
    return rounded(run_portfolio(member_returns(spark, sf), POLICY).metrics.drop("portfolio"), 6)


@query("p19_sector_exposure", with_(MCW, f"SELECT sector, {r('sum(weight)', 'exposure')} FROM (SELECT CASE symbol WHEN 'ASIA' THEN 'east' WHEN 'MIDDLE EAST' THEN 'east' WHEN 'EUROPE' THEN 'west' ELSE 'Unknown' END AS sector, weight FROM mw) GROUP BY sector"))
def p19(spark, sf):
    sectors = table(spark, sf, "region").select(
        F.col("r_name").alias("symbol"),
        F.when(F.col("r_name").isin("ASIA", "MIDDLE EAST"), "east").when(F.col("r_name") == "EUROPE", "west").alias("sector"),
    )
    return rounded(pf.sector_exposure(weighted(spark, sf)[1], sectors).drop("portfolio"))


@query("p20_normalised_curves", with_(SIM, f"SELECT t AS bar_idx, {r('(equity / first_value(equity) OVER (ORDER BY t) - 1) * 100', 'percent')} FROM pe"))
def p20(spark, sf):
    equity = run_portfolio(member_returns(spark, sf), POLICY).equity
    return rounded(pf.rebased(equity, ["portfolio"]).select("bar_idx", "percent"))


@query("p21_symbol_returns", with_(DRET, f"SELECT symbol, open_time, {rs('ret')} FROM ret"))
def p21(spark, sf):
    return rounded(daily_returns(spark, sf).select("symbol", "open_time", "ret"))
