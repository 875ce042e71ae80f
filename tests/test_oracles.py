"""Queries against their SQL at the smallest scale; TRIPWEAVE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck

ORACLES = entry.oracle_sql()
SAMPLE = [
    "qc_flag_rows", "qc_flag_audit", "qc_duration_before", "cell_summary_l6", "geohash_levels", "ring_gateways",
    "ring_crossings_per_arc", "departures_concentration", "daily_volume_gaps", "cell_hour_stats", "top_disjoint_blocks",
    "panel_slot_listed_units", "panel_hourly_lags", "group_flows_daily", "core_boundary_summary", "stock_allocation",
    "feature_profile_global", "feature_weather", "fold_week_forward", "score_by_dimension", "calibration_factors_compound",
    "network_rollup_actuals", "reconcile_arcs", "sink_clean_trips",
]


def test_names_agree():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TRIPWEAVE_ALL") else SAMPLE)
def test_equals_sql(spark, sf, name):
    assert differences(entry.queries()[name](spark, sf), duck(sf).sql(ORACLES[name])) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
