import math

from pyspark.sql import functions as F

from trackside.operators import profile, zones

COLS = ("Year int, Round int, SessionType string, Driver string, LapNumber int, TimeInLap double, "
        "Speed double, Brake boolean, Acceleration double, X double, Y double, sample_id long")


def lap(spark, samples, lapno=1):
    def f(v):
        return None if v is None else float(v)
    rows = [(2025, 1, "Q", "VER", lapno, f(t), f(s), b, f(a), f(x), f(y), i)
            for i, (t, s, b, a, x, y) in enumerate(samples)]
    return spark.createDataFrame(rows, COLS)


def test_zone_boundaries(spark):
    # braking runs: [0, 0.25] kept (inclusive), [1.0, 1.249] dropped, single sample dropped,
    # [3.0, 3.5] via deceleration only, run open at lap end [5.0, 5.3] kept
    s = [(0.0, 100.0, True, None, 0, 0), (0.25, 90.0, True, -3.0, 0, 0), (0.5, 95.0, False, 1.0, 0, 0),
         (1.0, 80.0, True, None, 0, 0), (1.249, 70.0, True, None, 0, 0), (2.0, 70.0, False, 0.0, 0, 0),
         (2.5, 60.0, True, None, 0, 0), (2.75, 60.0, False, 0.0, 0, 0),
         (3.0, 60.0, False, -2.5, 0, 0), (3.5, 55.0, False, -2.1, 0, 0), (4.0, 50.0, False, -1.0, 0, 0),
         (5.0, 40.0, True, -0.6, 0, 0), (5.3, 30.0, True, -0.4, 0, 0)]
    z = zones.braking_zones(lap(spark, s)).orderBy("zone_id").collect()
    assert [(round(r.duration, 6), r.entry_speed, r.apex_speed, r.exit_speed) for r in z] == [
        (0.25, 100.0, 90.0, 90.0), (0.5, 60.0, 55.0, 55.0), (0.3, 40.0, 30.0, 30.0)]
    assert [r.peak_decel for r in z] == [-3.0, -2.5, -0.6]
    st = zones.lap_zone_stats(zones.braking_zones(lap(spark, s))).first()
    assert st.Brake_Zones == 3 and math.isclose(st.Mean_Brake_Duration, (0.25 + 0.5 + 0.3) / 3)
    assert st.Max_Peak_Decel == -3.0


def test_no_zone_peak_zero(spark):
    s = [(0.0, 100.0, True, 0.0, 0, 0), (0.5, 90.0, True, 0.0, 0, 0)]
    z = zones.braking_zones(lap(spark, s)).first()
    assert z.peak_decel == 0.0


def test_lap_pct_distance_and_fallbacks(spark):
    moving = [(0.0, 1, False, None, 0.0, 0.0), (1.0, 1, False, None, 3.0, 4.0), (2.0, 1, False, None, None, 4.0),
              (3.0, 1, False, None, 6.0, 8.0), (4.0, 1, False, None, 6.0, 13.0)]
    got = [r.LapPct for r in profile.add_lap_pct(lap(spark, moving)).orderBy("TimeInLap").collect()]
    # steps: 0, 5, null->0, null->0 (prev X null), 5 -> cum 0,5,5,5,10
    assert got == [0.0, 50.0, 50.0, 50.0, 100.0]
    still = [(0.0, 1, False, None, 1.0, 1.0), (2.0, 1, False, None, 1.0, 1.0), (4.0, 1, False, None, 1.0, 1.0)]
    assert [r.LapPct for r in profile.add_lap_pct(lap(spark, still)).orderBy("TimeInLap").collect()] == [0.0, 50.0, 100.0]
    one = [(0.0, 1, False, None, 1.0, 1.0)]
    assert profile.add_lap_pct(lap(spark, one)).first().LapPct == 0.0


def test_thirds_exclude_lap_end(spark):
    s = [(float(i), 10.0 * i, i % 2 == 0, None, float(i), 0.0) for i in range(4)]
    m = profile.add_lap_pct(lap(spark, s))
    r = m.groupBy("LapNumber").agg(*profile.lap_profile_aggs(m)).first()
    # LapPct 0, 33.3.., 66.6.., 100 -> thirds hold one sample each except the last (100 is in none)
    assert r.Brake_First_Third == 100.0 and r.Brake_Mid_Third == 0.0 and r.Brake_Last_Third == 100.0


def test_sector_ratio_null_sector_pick(spark):
    cols = "Year int, Round int, SessionType string, Driver string, LapNumber int, TimeInLap double, " \
           "Sector1Time string, Sector2Time string, Sector3Time string"
    rows = [(2025, 1, "Q", "VER", 1, 0.0, "0:00:30.000000", "0:00:30.000000", "0:00:30.000000"),
            (2025, 1, "Q", "VER", 2, 0.0, "0:00:29.000000", None, "0:00:31.000000"),
            (2025, 1, "Q", "NOR", 1, 0.0, "0:00:31.000000", "0:00:29.000000", "0:00:32.000000")]
    r = {x.Driver: x for x in profile.sector_ratios(spark.createDataFrame(rows, cols)).collect()}
    # VER lap 2 has the smaller null-skipping sum (60 < 90) -> Sector2 null
    assert r["VER"].Sector1_Ratio == 1.0 and r["VER"].Sector2_Ratio is None
    assert r["NOR"].Sector2_Ratio == 1.0 and math.isclose(r["NOR"].Sector3_Ratio, 32 / 30)  # field best S3 = 30 (VER lap 1)
