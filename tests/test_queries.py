"""Registered queries against their SQL oracles (a cross-section; ``tests/compare.py`` runs all)."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a1_kline_normalise", "a2_daily_bars_by_region", "a7_gap_detection", "a8_backfill", "b10_period_label",
    "e4_enhanced_trades", "e5_metric_summary", "f4_fft_spectrum", "f7_sliding_dominant_period", "j3_align_union",
    "m4_percentiles", "o2_random_candidates", "o4_bayesian_search", "p10_portfolio_simulation", "r4_residual_quantile", "s6_entry_spacing",
    "t1_payload_parse", "t3_final_only_sink", "u1_dataframe_rule",
]


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


def test_every_operator_is_registered_once():
    names = list(entry.queries())
    assert set(entry.oracle_sql()) <= set(names) and len(names) == len(set(names))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare.differences(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


ACROSS = [
    "j1_asof_timeframes", "r7_trailing_stop", "e2_equity_curve", "e4_enhanced_trades", "e4_fixed_units_trades", "f2_dct_lowpass",
    "f4_fft_spectrum", "f6_welch_psd", "f7_sliding_dominant_period", "m4_simulation_metrics", "o12_combined_oos", "p8_rebalance_chain",
    "p10_portfolio_simulation", "s6_entry_spacing",
    "s8_timeframe_vote", "t6_replayed_batch",
]


@pytest.mark.parametrize("name", ACROSS)
def test_query_matches_oracle_across_chunks(spark, con, small_chunks, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare.differences(got, con.execute(entry.oracle_sql()[name]).df()) is None
