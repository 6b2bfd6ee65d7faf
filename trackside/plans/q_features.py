"""Queries: braking zones, lap distance and profiles, sector ratios, style
features, per-round z-scores and the driver feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import features, kinematics, laps, profile, zones
from trackside.plans.q_kinematics import ACC_SQL
from trackside.plans.common import round6
from trackside.plans.registry import register
from trackside.plans.sqlfrag import KEYS, LAPK, parse_dur, xmean
from trackside.sources.adapter import telemetry_view

# The adapter's laps hold 12-40 samples, so its fastest-lap floor is 15
# (library defaults stay 50 / 20).
ADAPTER_MIN_SAMPLES = 15
FEATS = S.STYLE_FEATURE_COLUMNS
ORD = '("TimeInLap" IS NULL, "TimeInLap", sample_id)'
WORDER = 'ORDER BY "TimeInLap" NULLS LAST, sample_id'


def _r6(df, cols):
    return round6(df, cols)


def _sel_r6(cols, prefix=""):
    return ", ".join(f'round({prefix}"{c}", 6) AS "{c}"' for c in cols)


def with_acc(spark, sf):
    return kinematics.add_acceleration(telemetry_view(spark, sf, dealt=True))


def _fmean(x):
    return xmean(x)


# Samples marked with zones and LapPct; ``src`` names the sample CTE to use.
def marked_sql(src: str, name: str) -> str:
    return f"""
{name}_0 AS (SELECT *, (COALESCE(CAST("Brake" AS INTEGER), 0) = 1 OR COALESCE("Acceleration" < -2.0, false)) AS _brk FROM {src}),
{name}_1 AS (SELECT *, lag(_brk) OVER wl AS _prevb,
     COALESCE(sqrt(("X" - lag("X") OVER wl) * ("X" - lag("X") OVER wl) + ("Y" - lag("Y") OVER wl) * ("Y" - lag("Y") OVER wl)), 0.0) AS _step
   FROM {name}_0 WINDOW wl AS (PARTITION BY {LAPK} {WORDER})),
{name}_2 AS (SELECT *, CAST(sum(CASE WHEN _brk AND NOT COALESCE(_prevb, false) THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS zone_id,
     sum(_step) OVER wr AS _cum
   FROM {name}_1 WINDOW wr AS (PARTITION BY {LAPK} {WORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_3 AS (SELECT *, last_value(_cum) OVER wa AS _total, last_value("TimeInLap") OVER wa AS _t_last,
     count(*) OVER wa AS _n
   FROM {name}_2 WINDOW wa AS (PARTITION BY {LAPK} {WORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT *, CASE WHEN _total > 0 THEN _cum / _total * 100.0
                    WHEN _n > 1 AND _t_last > 0 THEN "TimeInLap" / _t_last * 100.0 ELSE 0.0 END AS "LapPct"
   FROM {name}_3)"""


def zones_sql(src: str, name: str) -> str:
    return f"""
{name} AS (SELECT * FROM (
   SELECT {LAPK}, zone_id, arg_min_null("Speed", {ORD}) AS entry_speed, min("Speed") AS apex_speed,
          arg_max_null("Speed", {ORD}) AS exit_speed,
          arg_max_null("TimeInLap", {ORD}) - arg_min_null("TimeInLap", {ORD}) AS duration,
          COALESCE(min("Acceleration") FILTER (WHERE "Acceleration" < -0.5), 0.0) AS peak_decel,
          count(*) AS samples
   FROM {src} WHERE _brk GROUP BY ALL) WHERE duration >= 0.25)"""


def lap_aggs_sql(src: str, name: str) -> str:
    b = 'CAST("Brake" AS INTEGER)'
    prof = []
    for p in S.SPEED_PCT_POINTS:
        cond = f'"LapPct" >= {p - 5} AND "LapPct" < {p + 5}'
        prof.append(f'{_fmean(f"CASE WHEN {cond} THEN \"Speed\" END")} AS "Speed_Pct_{p}"')
    for label, lo, hi in S.BRAKE_THIRDS:
        cond = f'"LapPct" >= {lo} AND "LapPct" < {hi}'
        prof.append(f'{_fmean(f"CASE WHEN {cond} THEN {b} END")} * 100.0 AS "{label}"')
    return f"""
{name} AS (SELECT {LAPK}, {_fmean('"Speed"')} AS "Avg_Speed", max("Speed") AS "Max_Speed",
     {_fmean('"Throttle"')} AS "Avg_Throttle", {_fmean(b)} * 100.0 AS "Brake_Pct", {_fmean('"RPM"')} AS "Avg_RPM",
     arg_max_null("TimeInLap", {ORD}) - arg_min_null("TimeInLap", {ORD}) AS _lap_time, count(*) AS _samples,
     {", ".join(prof)}
   FROM {src} GROUP BY ALL)"""


ZSTATS_SQL = f"""
zs AS (SELECT {LAPK}, count(*) AS "Brake_Zones", avg(entry_speed) AS "Mean_Entry_Speed",
     avg(apex_speed) AS "Mean_Apex_Speed", avg(exit_speed) AS "Mean_Exit_Speed",
     avg(duration) AS "Mean_Brake_Duration", stddev_pop(duration) AS "Std_Brake_Duration",
     avg(peak_decel) AS "Mean_Peak_Decel", min(peak_decel) AS "Max_Peak_Decel", sum(duration) AS "Brake_Time"
   FROM fzones GROUP BY ALL)"""

SECTOR_SQL = f"""
sr_lap AS (SELECT {LAPK},
     {", ".join(f'first({parse_dur(f"Sector{i}Time")} ORDER BY "TimeInLap" NULLS LAST, sample_id) FILTER (WHERE {parse_dur(f"Sector{i}Time")} IS NOT NULL) AS S{i}' for i in (1, 2, 3))}
   FROM tel WHERE "Driver" IS NOT NULL GROUP BY ALL),
sr_best AS (SELECT {KEYS}, min(S1) AS b1, min(S2) AS b2, min(S3) AS b3 FROM sr_lap GROUP BY ALL),
sr_pick AS (SELECT {KEYS}, "Driver",
     {", ".join(f'arg_min_null(S{i}, (COALESCE(S1, 0.0) + COALESCE(S2, 0.0) + COALESCE(S3, 0.0), "LapNumber")) AS S{i}' for i in (1, 2, 3))}
   FROM sr_lap GROUP BY ALL),
sr AS (SELECT {KEYS}, "Driver",
     {", ".join(f'CASE WHEN b{i} > 0 THEN S{i} / b{i} END AS "Sector{i}_Ratio"' for i in (1, 2, 3))}
   FROM sr_pick JOIN sr_best USING ({KEYS}))"""

FASTEST_SQL = f"""
fl_valid AS (SELECT *, {parse_dur('"LapTime"')} AS lts FROM acc),
fl_pick AS (SELECT {KEYS}, "Driver", arg_min("LapNumber", (lts, "LapNumber")) AS "LapNumber"
   FROM fl_valid WHERE lts IS NOT NULL GROUP BY ALL),
fl AS (SELECT v.* FROM fl_valid v JOIN fl_pick p USING ({LAPK}) WHERE v.lts IS NOT NULL)"""

RDF_SQL = (FASTEST_SQL + "," + marked_sql("fl", "fm") + "," + zones_sql("fm", "fzones") + ","
           + lap_aggs_sql("fm", "flap") + "," + ZSTATS_SQL + "," + SECTOR_SQL + f""",
rdf AS (
  SELECT l.{KEYS.replace(', ', ', l.')}, l."Driver",
    {", ".join(
        'CAST(COALESCE(z."Brake_Zones", 0) AS DOUBLE) AS "Brake_Zones"' if c == "Brake_Zones" else
        'CASE WHEN l._lap_time > 0 THEN COALESCE(z."Brake_Time", 0.0) / l._lap_time * 100.0 ELSE 0.0 END AS "Brake_Time_Pct"'
        if c == "Brake_Time_Pct" else
        f'z."{c}"' if c in features.ZONE_COLS else
        f's."{c}"' if c.startswith("Sector") else f'l."{c}"'
        for c in FEATS)}
  FROM flap l LEFT JOIN zs z USING ({LAPK}) LEFT JOIN sr s USING ({KEYS}, "Driver")
  WHERE l._samples >= {ADAPTER_MIN_SAMPLES})""")

ZSCORE_SQL = RDF_SQL + f""",
zstat AS (SELECT {KEYS}, {", ".join(f'avg("{c}") AS "mu_{c}", stddev_samp("{c}") AS "sd_{c}", min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in FEATS)}
   FROM rdf GROUP BY ALL),
zr AS (SELECT {KEYS}, "Driver", {", ".join(f'CASE WHEN "sd_{c}" IS NULL OR "sd_{c}" = 0 OR "lo_{c}" = "hi_{c}" THEN 0.0 ELSE ("{c}" - "mu_{c}") / "sd_{c}" END AS "{c}"' for c in FEATS)}
   FROM rdf JOIN zstat USING ({KEYS}))"""


def rdf(spark, sf):
    return features.round_driver_features(with_acc(spark, sf), min_lap_samples=ADAPTER_MIN_SAMPLES,
                                          min_feature_samples=ADAPTER_MIN_SAMPLES, exact_mean=True, dealt=True)


@register("fastest_lap_samples", ACC_SQL + "," + FASTEST_SQL + f"""
---
SELECT {LAPK}, sample_id, "TimeInLap", "Speed", "Throttle" FROM fl""")
def q_fastest_lap_samples(spark, sf):
    f = laps.fastest_lap_samples(telemetry_view(spark, sf))
    return f.select(*S.LAP_KEYS, "sample_id", "TimeInLap", "Speed", "Throttle")


@register("lap_trace", ACC_SQL + "," + FASTEST_SQL + f"""
---
SELECT {KEYS}, "Driver", "TimeInLap", "Speed", "Throttle", sample_id,
       CAST(row_number() OVER (PARTITION BY {KEYS}, "Driver" {WORDER}) AS INTEGER) AS "Point" FROM fl""")
def q_lap_trace(spark, sf):
    """CH-2: fastest-lap trace (TimeInLap, Speed, Throttle) of every driver, ordered."""
    from pyspark.sql import Window
    f = laps.fastest_lap_samples(telemetry_view(spark, sf))
    w = Window.partitionBy(*S.SESSION_KEYS, "Driver").orderBy(F.col("TimeInLap").asc_nulls_last(), "sample_id")
    return f.select(*S.SESSION_KEYS, "Driver", "TimeInLap", "Speed", "Throttle", "sample_id",
                    F.row_number().over(w).alias("Point"))


@register("track_map", ACC_SQL + "," + FASTEST_SQL + f"""
---
SELECT {KEYS}, "Driver", "X", "Y", "Speed", "Throttle", "RPM", sample_id FROM fl
WHERE ({KEYS}, "Driver") IN (SELECT ({KEYS}, "Driver") FROM fl GROUP BY {KEYS}, "Driver"
                             HAVING count("X") > 0 AND count("Y") > 0)""")
def q_track_map(spark, sf):
    """CH-3 + FLT-10: fastest-lap XY with metrics, laps with some position data."""
    f = laps.track_map_samples(telemetry_view(spark, sf))
    return f.select(*S.SESSION_KEYS, "Driver", "X", "Y", "Speed", "Throttle", "RPM", "sample_id")


@register("braking_zones", ACC_SQL + "," + marked_sql("acc", "am") + "," + zones_sql("am", "azones") + f"""
---
SELECT {LAPK}, zone_id, round(entry_speed, 6) AS entry_speed, round(apex_speed, 6) AS apex_speed,
       round(exit_speed, 6) AS exit_speed, round(duration, 6) AS duration, round(peak_decel, 6) AS peak_decel,
       samples FROM azones""")
def q_braking_zones(spark, sf):
    z = zones.braking_zones(with_acc(spark, sf))
    return _r6(z, ["entry_speed", "apex_speed", "exit_speed", "duration", "peak_decel"])


@register("lap_zone_stats", ACC_SQL + "," + marked_sql("acc", "am") + "," + zones_sql("am", "fzones") + ","
          + ZSTATS_SQL + f"""
---
SELECT {LAPK}, "Brake_Zones", {_sel_r6(features.ZONE_COLS + ["Brake_Time"])} FROM zs""")
def q_lap_zone_stats(spark, sf):
    z = zones.lap_zone_stats(zones.braking_zones(with_acc(spark, sf)))
    return _r6(z, features.ZONE_COLS + ["Brake_Time"])


@register("lap_pct", ACC_SQL + "," + marked_sql("acc", "am") + f"""
---
SELECT {LAPK}, sample_id, round("LapPct", 6) AS "LapPct" FROM am""")
def q_lap_pct(spark, sf):
    p = profile.add_lap_pct(with_acc(spark, sf))
    return _r6(p.select(*S.LAP_KEYS, "sample_id", "LapPct"), ["LapPct"])


_PROFILE = [f"Speed_Pct_{p}" for p in S.SPEED_PCT_POINTS]
_THIRDS = [t[0] for t in S.BRAKE_THIRDS]
_SCALARS = ["Avg_Speed", "Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM"]


def _lap_aggs(spark, sf):
    m = profile.add_lap_pct(with_acc(spark, sf))
    return m.groupBy(*S.LAP_KEYS).agg(*profile.lap_scalar_aggs(m, True), *profile.lap_profile_aggs(m, True))


@register("speed_profile", ACC_SQL + "," + marked_sql("acc", "am") + "," + lap_aggs_sql("am", "la") + f"""
---
SELECT {LAPK}, {_sel_r6(_PROFILE)} FROM la""")
def q_speed_profile(spark, sf):
    return _r6(_lap_aggs(spark, sf).select(*S.LAP_KEYS, *_PROFILE), _PROFILE)


@register("brake_thirds", ACC_SQL + "," + marked_sql("acc", "am") + "," + lap_aggs_sql("am", "la") + f"""
---
SELECT {LAPK}, {_sel_r6(_THIRDS)} FROM la""")
def q_brake_thirds(spark, sf):
    return _r6(_lap_aggs(spark, sf).select(*S.LAP_KEYS, *_THIRDS), _THIRDS)


@register("lap_scalars", ACC_SQL + "," + marked_sql("acc", "am") + "," + lap_aggs_sql("am", "la") + f"""
---
SELECT {LAPK}, {_sel_r6(_SCALARS)}, round(_lap_time, 6) AS "Lap_Time", _samples AS "Samples" FROM la""")
def q_lap_scalars(spark, sf):
    a = _lap_aggs(spark, sf).select(*S.LAP_KEYS, *_SCALARS, F.col("_lap_time").alias("Lap_Time"),
                                    F.col("_samples").alias("Samples"))
    return _r6(a, _SCALARS + ["Lap_Time"])


@register("sector_ratios", SECTOR_SQL + f"""
---
SELECT {KEYS}, "Driver", {_sel_r6(["Sector1_Ratio", "Sector2_Ratio", "Sector3_Ratio"])} FROM sr""")
def q_sector_ratios(spark, sf):
    return _r6(profile.sector_ratios(telemetry_view(spark, sf)), ["Sector1_Ratio", "Sector2_Ratio", "Sector3_Ratio"])


@register("round_driver_features", ACC_SQL + "," + RDF_SQL + f"""
---
SELECT {KEYS}, "Driver", {_sel_r6(FEATS)} FROM rdf""")
def q_round_driver_features(spark, sf):
    return _r6(rdf(spark, sf), FEATS)


@register("zscore_round", ACC_SQL + "," + ZSCORE_SQL + f"""
---
SELECT {KEYS}, "Driver", {_sel_r6(FEATS)} FROM zr""")
def q_zscore_round(spark, sf):
    return _r6(features.zscore_within_round(rdf(spark, sf)), FEATS)


@register("driver_feature_matrix", ACC_SQL + "," + ZSCORE_SQL + f"""
---
SELECT "Driver", {", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in FEATS)} FROM zr GROUP BY "Driver\"""")
def q_driver_feature_matrix(spark, sf):
    return _r6(features.driver_feature_matrix(rdf(spark, sf)), FEATS)
