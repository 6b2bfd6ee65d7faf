"""Queries: duration text, lap tables, best laps, classification, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside.functions import driver_color, format_gap, format_laptime, parse_duration_seconds
from trackside.operators import laps
from trackside.plans.registry import register
from trackside.plans.sqlfrag import KEYS, LAPK, fmt_gap, fmt_laptime, parse_dur
from trackside.schemas import DEFAULT_COLOR, DRIVER_COLORS, SESSION_KEYS
from trackside.sources.adapter import telemetry_view

_COLOR_CASE = ("CASE upper(\"Driver\") " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DRIVER_COLORS.items())
               + f" ELSE '{DEFAULT_COLOR}' END")

# Per-lap first-value table in SQL (AG-1): first non-null by TimeInLap, sample_id.
LAP_FIRST_SQL = f"""
lapt AS (
  SELECT {LAPK},
         first("LapTime" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "LapTime" IS NOT NULL) AS "LapTime",
         first("Sector1Time" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "Sector1Time" IS NOT NULL) AS "Sector1Time",
         first("Sector2Time" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "Sector2Time" IS NOT NULL) AS "Sector2Time",
         first("Sector3Time" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "Sector3Time" IS NOT NULL) AS "Sector3Time",
         first("Compound" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "Compound" IS NOT NULL) AS "Compound",
         count(*) AS "Samples"
  FROM tel GROUP BY ALL
)"""

BEST_SQL = f"""
valid AS (SELECT *, {parse_dur('"LapTime"')} AS lts FROM tel),
per_lap AS (
  SELECT {LAPK},
         first(lts ORDER BY "TimeInLap", sample_id) AS "LapTime_seconds",
         first("Compound" ORDER BY "TimeInLap", sample_id) FILTER (WHERE "Compound" IS NOT NULL) AS "Compound"
  FROM valid WHERE lts IS NOT NULL GROUP BY ALL
),
best AS (
  SELECT {KEYS}, "Driver",
         arg_min("LapNumber", ("LapTime_seconds", "LapNumber")) AS "LapNumber",
         min("LapTime_seconds") AS "LapTime_seconds",
         arg_min("Compound", ("LapTime_seconds", "LapNumber")) AS "Compound"
  FROM per_lap GROUP BY ALL
),
bl AS (
  SELECT *, "LapTime_seconds" - min("LapTime_seconds") OVER (PARTITION BY {KEYS}) AS "Gap" FROM best
),
cls AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY "LapTime_seconds", "Driver") AS INTEGER) AS "Pos" FROM bl
)"""


@register("laptime_parse", """
SELECT DISTINCT "LapTime", """ + parse_dur('"LapTime"') + """ AS "LapTime_seconds" FROM tel
""")
def q_laptime_parse(spark, sf):
    tel = telemetry_view(spark, sf)
    return tel.select("LapTime", parse_duration_seconds("LapTime").alias("LapTime_seconds")).distinct()


@register("lap_table", LAP_FIRST_SQL + "\n---\n" + f"""
SELECT *, {parse_dur('"LapTime"')} AS "LapTime_seconds",
       {parse_dur('"Sector1Time"')} AS "Sector1Time_seconds",
       {parse_dur('"Sector2Time"')} AS "Sector2Time_seconds",
       {parse_dur('"Sector3Time"')} AS "Sector3Time_seconds"
FROM lapt
""")
def q_lap_table(spark, sf):
    return laps.lap_table(telemetry_view(spark, sf))


@register("laptime_format", LAP_FIRST_SQL + "\n---\n" + f"""
SELECT {LAPK}, {parse_dur('"LapTime"')} AS "LapTime_seconds",
       {fmt_laptime(parse_dur('"LapTime"'))} AS "LapTimeText"
FROM lapt
""")
def q_laptime_format(spark, sf):
    lt = laps.lap_table(telemetry_view(spark, sf), attrs=["LapTime"])
    return lt.select(*SESSION_KEYS, "Driver", "LapNumber", "LapTime_seconds",
                     format_laptime("LapTime_seconds").alias("LapTimeText"))


@register("best_laps", BEST_SQL + "\n---\n" + f"""
SELECT {KEYS}, "Driver", "LapNumber", "LapTime_seconds", "Compound", "Gap" FROM bl
""")
def q_best_laps(spark, sf):
    return laps.best_laps(telemetry_view(spark, sf))


@register("classification", BEST_SQL + "\n---\n" + f"""
SELECT {KEYS}, "Pos", "Driver", "LapNumber", "LapTime_seconds", "Compound", "Gap",
       {fmt_laptime('"LapTime_seconds"')} AS "LapTimeText", {fmt_gap('"Gap"')} AS "GapText",
       {_COLOR_CASE} AS "Color"
FROM cls
""")
def q_classification(spark, sf):
    c = laps.classification(telemetry_view(spark, sf))
    return c.select(*SESSION_KEYS, "Pos", "Driver", "LapNumber", "LapTime_seconds", "Compound", "Gap",
                    format_laptime("LapTime_seconds").alias("LapTimeText"),
                    format_gap("Gap").alias("GapText"),
                    driver_color("Driver").alias("Color"))


@register("gap_text", BEST_SQL + "\n---\n" + f"""
SELECT {KEYS}, "Driver", "Gap", {fmt_gap('"Gap"')} AS "GapText" FROM bl
""")
def q_gap_text(spark, sf):
    bl = laps.best_laps(telemetry_view(spark, sf))
    return bl.select(*SESSION_KEYS, "Driver", "Gap", format_gap("Gap").alias("GapText"))


@register("top10_laps", BEST_SQL + "\n---\n" + f"""
SELECT {KEYS}, "Pos", "Driver", "LapTime_seconds", "Gap" FROM cls WHERE "Pos" <= 10
""")
def q_top10_laps(spark, sf):
    """TK-2: ten best laps per session (two-phase top-n on the per-driver table)."""
    from trackside.operators.common import top_n
    bl = laps.best_laps(telemetry_view(spark, sf))
    t = top_n(bl, SESSION_KEYS, [F.col("LapTime_seconds"), F.col("Driver")], 10, rank_col="Pos",
              salt_by=["Driver"])
    return t.select(*SESSION_KEYS, "Pos", "Driver", "LapTime_seconds", "Gap")


@register("top10_spread", BEST_SQL + "\n---\n" + f"""
SELECT {KEYS}, count(*) AS "Drivers",
       arg_min("Driver", "Pos") AS "PoleDriver",
       {fmt_laptime('min("LapTime_seconds")')} AS "PoleLap",
       max("Gap") FILTER (WHERE "Pos" <= 10) AS "Top10Spread",
       {fmt_gap('max("Gap") FILTER (WHERE "Pos" <= 10)')} AS "Top10SpreadText"
FROM cls GROUP BY ALL
""")
def q_top10_spread(spark, sf):
    c = laps.classification(telemetry_view(spark, sf))
    out = c.groupBy(*SESSION_KEYS).agg(
        F.count(F.lit(1)).alias("Drivers"),
        F.min_by("Driver", "Pos").alias("PoleDriver"),
        F.min("LapTime_seconds").alias("_pole"),
        F.max(F.when(F.col("Pos") <= 10, F.col("Gap"))).alias("Top10Spread"),
    )
    return out.select(*SESSION_KEYS, "Drivers", "PoleDriver", format_laptime("_pole").alias("PoleLap"),
                      "Top10Spread", format_gap("Top10Spread").alias("Top10SpreadText"))
