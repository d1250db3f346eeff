"""Queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tapewright.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = """daily_pick_returns p1_prepare_panel p5_heal_previous_close p8_base_price_events p9_back_adjust p10_merge_and_adjust p16_day_continuity p19_index_and_proxies
c1_sessions c4_asof_strict c5_asof_inclusive c6_next_session c11_class_verdict c14_read_as_of l1_tick_size l3_round_trip_cost l7_forward_exit l9_multi_targets
b1_decision_bars b5_decision_day_rows b15_tick_bar_relation b23_vendor_equivalence f1_cross_section f2_history f4_lagged_flow_density f6_trailing f13_robust_z f17_scenarios
u7_select_roster u12_portfolio e6_newey_west e7_nav e10_cpcv_folds e15_path_evidence g1_order_state g5_round_trips g10_shadow_ledger g13_trailing_attempts s7_shrink_guard s15_base_and_patch n2_vendor_bars n6_exchange_block t1_minute_bars t5_order_state
f12_snapshot_block f15_pair_correlations f19_action_panel f22_feature_contract f23_noise_perturbation b26_calibration_rows b27_share_history b28_ewma_prediction b29_fit_estimator b29_frontier b30_reconstruct b31_auction_moves e4_block_bootstrap e5_deflated_sharpe e8_rank_ic e13_seam_purge e16_paired_test e22_fidelity
l4_row_costs l13_buyability l13_buyability_report l14_leakage_guard m7_dataset_build m8_tiered_dataset n3_canonical_bars n18_front_month g3_broker_matches g8_fill_decision g8_auction_fills g17_streaks g18_job_lateness t4_running_decision t8_upsert_sink
g11_exit_arms g11_attribution g11_attribution_summary e21_certification_daily e20_paired_intervals e1_intervals_by_year e18_leaderboard e2_regime_metrics e3_cost_verdict e3_cost_stress u10_constructible e17_age_weights e17_ranking_grades e17_balanced_weights t5_order_corruption t3_late_in_stream s15_monthly_rebuild""".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns, key=lambda c: (c not in ("date", "trade_date", "snapshot_date", "symbol", "stock_code"), c))
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(cols)
    place = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_every_query_is_callable_and_named_once():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 180
