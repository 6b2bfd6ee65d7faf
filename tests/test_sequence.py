"""A scan over slices must give the same results as one window over the whole lap."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import features, kinematics, profile, sequence, zones
from trackside.sources.adapter import telemetry_view
from tests.test_features_clustering import synthetic_season


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def _compare(df_a, df_b, key, cols):
    ra = {tuple(r[k] for k in key): r for r in df_a.collect()}
    rb = {tuple(r[k] for k in key): r for r in df_b.collect()}
    assert ra.keys() == rb.keys() and len(ra) > 0
    for k in ra:
        for c in cols:
            assert _close(ra[k][c], rb[k][c]), (k, c, ra[k][c], rb[k][c])


@pytest.fixture(params=[(25.0, 1 << 16), (0.01, 3)], ids=["few rows a slice", "one row a slice"])
def sliced(monkeypatch, request):
    def on():
        monkeypatch.setattr(sequence, "SLICE_SECONDS", request.param[0])
        monkeypatch.setattr(sequence, "TIE_SPAN", request.param[1])
    return on


def test_acceleration_zones_pct_split_equal(spark, sliced):
    tel = telemetry_view(spark, "/root/testdata/sf0.001")
    plain_acc = kinematics.add_acceleration(tel)
    plain_z = zones.mark_zones(plain_acc)
    plain_p = profile.add_lap_pct(plain_acc)
    plain = [plain_acc.collect(), plain_z.collect(), plain_p.collect()]
    plain_stats = zones.lap_zone_stats(zones.zone_features(plain_z)).collect()
    sliced()
    split_acc = kinematics.add_acceleration(tel)
    assert split_acc.columns == plain_acc.columns and split_acc.count() == len(plain[0])
    _compare(spark.createDataFrame(plain[0]), split_acc, ["sample_id"], ["Acceleration", "Accel_Type", "Speed_ms"])
    marked = zones.mark_zones(split_acc)
    _compare(spark.createDataFrame(plain[1]), marked, ["sample_id"], ["_braking", "zone_id"])
    _compare(spark.createDataFrame(plain[2]), profile.add_lap_pct(split_acc), ["sample_id"], ["LapPct"])
    # zones that run over slices are merged by the grouped aggregate
    _compare(spark.createDataFrame(plain_stats), zones.lap_zone_stats(zones.zone_features(marked)), S.LAP_KEYS,
             ["Brake_Zones", "Mean_Entry_Speed", "Mean_Exit_Speed", "Mean_Brake_Duration", "Brake_Time", "Max_Peak_Decel"])


def test_style_features_split_equal(spark, sliced):
    tel = kinematics.add_acceleration(synthetic_season(spark, n_points=60))
    plain = features.round_driver_features(tel, min_lap_samples=20).collect()
    sliced()
    split = features.round_driver_features(tel, min_lap_samples=20)
    _compare(spark.createDataFrame(plain), split, ["Round", "Driver"], S.STYLE_FEATURE_COLUMNS)


def brute(rows, lag, inc):
    """Lag, running sum, total, last time and count per lap by plain Python."""
    laps = {}
    for r in rows:
        laps.setdefault(r[0], []).append(r)
    out = {}
    for lap, rs in laps.items():
        rank = lambda t: (2, 0) if t is None else (1, 0) if math.isnan(t) else (0, t)
        rs = sorted(rs, key=lambda r: (rank(r[1]), r[2]))
        total, prev = 0.0, None
        for r in rs:
            total += inc(r, prev)
            out[r[2]] = [prev[lag] if prev else None, total]
            prev = r
        for r in rs:
            out[r[2]] += [total, rs[-1][1], len(rs)]
    return out


@pytest.mark.parametrize("slice_seconds,tie_span", [(600.0, 1 << 16), (600.0, 5), (7.0, 5), (0.25, 1)])
def test_odd_laps_against_brute_force(spark, slice_seconds, tie_span):
    """Laps of one time value (0, null), negative times, ten years, NaN, gaps of many slices, equal times."""
    rng = random.Random(4)
    rows, n = [], 0
    def add(lap, times):
        nonlocal n
        ids = list(range(n, n + len(times)))
        n += len(times)
        rng.shuffle(ids)
        rows.extend((lap, t, i, float(rng.randrange(9))) for t, i in zip(times, ids))
    add(1, [0.0] * 60)
    add(2, [None] * 40)
    add(3, [rng.uniform(-50, 50) for _ in range(60)])
    add(4, [0.0, 1.5, 3.2e8, 3.2e8, 3.2e8 + 1, float("nan"), float("nan"), None])
    add(5, [float(k // 3) for k in range(60)])
    add(6, [0.0, 0.0, 5000.0, None, 0.1])
    add(7, [rng.choice([0.0, 0.5, 7.0, 14.0, None, 600.0, 1200.0]) for _ in range(80)])
    add(8, [0.0, 0.2, 0.4])
    df = spark.createDataFrame(rows, "lap int, t double, id long, v double").repartition(4)
    got = sequence.lap_scan(df, keys=["lap"], time_col="t", tie_col="id", lags=["v"], lap_totals=True, lap_last=["t"],
                            lap_count="n", running={"s": lambda p: F.col("v") * 2 + F.coalesce(p["v"], F.lit(1.0))},
                            slice_seconds=slice_seconds, tie_span=tie_span)
    assert got.columns == ["lap", "t", "id", "v", "_prev_v", "s", "s_lap_total", "_last_t", "n"]
    want = brute(rows, 3, lambda r, p: r[3] * 2 + (p[3] if p else 1.0))
    found = {r.id: [r._prev_v, r.s, r.s_lap_total, r._last_t, r.n] for r in got.collect()}
    assert found.keys() == want.keys()
    for i in want:
        assert all(_close(a, b) or (b != b and a != a) for a, b in zip(found[i], want[i])), (i, found[i], want[i])


def test_a_lap_of_one_time_value_is_split(spark):
    df = spark.range(1000).selectExpr("1 AS lap", "CAST(0 AS DOUBLE) AS t", "id", "1.0D AS v")
    cut = sequence.slice_columns(df, "t", "id", 600.0, 50)
    sizes = [r["count"] for r in df.withColumns(cut).groupBy("lap", *sequence.SLICE).count().collect()]
    assert len(sizes) == 20 and set(sizes) == {50}


def test_sound_laps_take_one_window_and_one_exchange(spark):
    df = spark.createDataFrame([(1, float(t), t, 1.0) for t in range(90)], "lap int, t double, id long, v double")
    got = sequence.lap_scan(df, keys=["lap"], time_col="t", tie_col="id", lags=["v"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
