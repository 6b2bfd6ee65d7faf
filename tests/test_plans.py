"""Physical-plan regression checks (initial adaptive plans at sf0.001)."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def count(p, token):
    return p.count(token)


def test_corner_tagging_has_no_join(spark):
    p = plan(spark, "nearest_corner")
    assert "Join" not in p and count(p, "Exchange ") <= 1


def test_asof_is_one_bucketed_window(spark):
    p = plan(spark, "asof_nearest")
    assert count(p, "Exchange ") == 1 and "Join" not in p


def test_single_scan_plans(spark):
    for name in ("braking_zones", "corner_leaders", "driver_summary", "lap_pct", "processed_telemetry"):
        assert count(plan(spark, name), "FileScan") == 1, name


def test_lap_features_scan_once_and_shuffle_samples_once(spark):
    from trackside.operators import features, kinematics, laps
    from trackside.sources.adapter import telemetry_view
    tel = kinematics.add_acceleration(telemetry_view(spark, SF))
    parts = features.all_lap_features(laps.with_laptime_seconds(tel))
    p = parts._jdf.queryExecution().executedPlan().toString()
    # adapter, acceleration, zones, lap distance and the lap table share one exchange
    assert count(p, "FileScan") == 1 and count(p, "Exchange ") == 1


def test_no_window_over_a_whole_session(spark):
    for name in ("classification", "best_laps", "sector_ratios", "zscore_round", "driver_feature_matrix", "corner_bars"):
        for line in plan(spark, name).splitlines():
            if "Window [" in line and "SessionType" in line:
                # keyed by a lap, a driver or a second of lap time, or over the table of slice (bucket) sizes
                keys = line.rsplit("], [", 2)[-2]
                assert any(x in keys for x in ("Driver", "LapNumber", "_bucket")) or "_slice" in line or "_bucket" in line, (name, line[:300])


def test_column_pruning_and_pushdown_reach_the_scan(spark):
    scans = [ln for ln in plan(spark, "asof_nearest").splitlines() if "FileScan" in ln]
    assert len(scans) == 2
    for ln in scans:
        assert "props" not in ln                       # unused column not read
        assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type," in ln


@pytest.mark.parametrize("name", ["dedupe_first", "gear_counts", "session_semi"])
def test_aggregates_have_one_exchange(spark, name):
    assert count(plan(spark, name), "Exchange ") <= 1


def test_rejects_align_the_samples_once(spark):
    p = plan(spark, "api_rejects")
    assert count(p, "_ls") > 0 and sum("collect_set" in ln and "partial_collect_set" not in ln for ln in p.splitlines()) == 1
