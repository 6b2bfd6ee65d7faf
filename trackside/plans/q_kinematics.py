"""Queries: acceleration, corners, driver/corner summaries, counts, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import kinematics, summaries
from trackside.plans.common import r6, round6
from trackside.plans.registry import register
from trackside.plans.sqlfrag import KEYS, accel_type, clip, xmean
from trackside.sources.adapter import read_table, telemetry_view

# The adapter's rounds 0..3 all use the round-1 corner table.
ADAPTER_ROUNDS = [0, 1, 2, 3]
ADAPTER_CORNERS = {r: S.CIRCUIT_CORNERS[1] for r in ADAPTER_ROUNDS}


_AG4_FLOATS = ["Avg_Speed", "Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM", "Max_RPM"]


def _r6_all(df):
    return round6(df, [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"])


def processed(spark, sf):
    return kinematics.process_telemetry(telemetry_view(spark, sf), corners=ADAPTER_CORNERS)


_corner_values = ", ".join(
    f"({r}, {i}, '{name}', {(xr[0] + xr[1]) / 2.0!r}, {(yr[0] + yr[1]) / 2.0!r})"
    for r, cs in ADAPTER_CORNERS.items() for i, (name, xr, yr) in enumerate(cs))

ACC_SQL = f"""
acc0 AS (
  SELECT *, "Speed" / 3.6 AS "Speed_ms",
         "TimeInLap" - lag("TimeInLap") OVER w AS _dt,
         "Speed" / 3.6 - lag("Speed" / 3.6) OVER w AS _dv
  FROM tel
  WINDOW w AS (PARTITION BY {KEYS}, "DriverNumber", "LapNumber" ORDER BY "TimeInLap" NULLS LAST, sample_id)
),
acc AS (
  SELECT * EXCLUDE (_dt, _dv, _a), _a AS "Acceleration", {accel_type('_a')} AS "Accel_Type"
  FROM (SELECT *, CASE WHEN _dt > 0 THEN {clip('_dv / _dt')} END AS _a FROM acc0)
),
corners(c_round, corner_ord, c_name, cx, cy) AS (VALUES {_corner_values}),
cbest AS (
  SELECT t.sample_id, arg_min(c.c_name, (d, c.corner_ord)) AS cname, min(d) AS dmin
  FROM (SELECT sample_id, "Round", "X", "Y" FROM tel WHERE "X" IS NOT NULL AND "Y" IS NOT NULL) t
  JOIN corners c ON t."Round" = c.c_round,
  LATERAL (SELECT sqrt((t."X" - c.cx) * (t."X" - c.cx) + (t."Y" - c.cy) * (t."Y" - c.cy)) AS d)
  GROUP BY t.sample_id
),
proc AS (
  SELECT a.*, CASE WHEN b.dmin < 500 THEN b.cname END AS "Corner"
  FROM acc a LEFT JOIN cbest b USING (sample_id)
)"""


def sql(body: str, pre: str = "") -> str:
    return ACC_SQL + ("," + pre if pre else "") + "\n---\n" + body


@register("acceleration", sql(f"""
SELECT {KEYS}, "DriverNumber", "LapNumber", sample_id, "TimeInLap", "Speed_ms", "Acceleration", "Accel_Type"
FROM acc"""))
def q_acceleration(spark, sf):
    a = kinematics.add_acceleration(telemetry_view(spark, sf))
    return a.select(*S.SESSION_KEYS, "DriverNumber", "LapNumber", "sample_id", "TimeInLap", "Speed_ms",
                    "Acceleration", "Accel_Type")


@register("accel_type", sql("""
SELECT "Accel_Type", count(*) AS "Rows", count(*) FILTER (WHERE abs("Acceleration") = 15.0) AS "Clipped"
FROM acc GROUP BY ALL"""))
def q_accel_type(spark, sf):
    a = kinematics.add_acceleration(telemetry_view(spark, sf))
    return a.groupBy("Accel_Type").agg(F.count(F.lit(1)).alias("Rows"),
                                       F.count(F.when(F.abs("Acceleration") == 15.0, 1)).alias("Clipped"))


@register("nearest_corner", sql("""
SELECT sample_id, "Round", "X", "Y", "Corner" FROM proc"""))
def q_nearest_corner(spark, sf):
    t = kinematics.tag_corners(telemetry_view(spark, sf), ADAPTER_CORNERS)
    return t.select("sample_id", "Round", "X", "Y", "Corner")


@register("nearest_corner_table", sql("""
SELECT sample_id, "Round", "X", "Y", "Corner" FROM proc"""))
def q_nearest_corner_table(spark, sf):
    """Same as nearest_corner with the corner dimension given as a DataFrame."""
    rows = [r for r in S.corner_rows(ADAPTER_CORNERS)]
    corners = spark.createDataFrame(rows, S.CORNER_SCHEMA)
    t = kinematics.tag_corners(telemetry_view(spark, sf), corners)
    return t.select("sample_id", "Round", "X", "Y", "Corner")


@register("driver_summary", sql(f"""
SELECT {KEYS}, "Driver",
       round_even({xmean('"Speed"')}, 6) AS "Avg_Speed", round_even(max("Speed"), 6) AS "Max_Speed",
       round_even({xmean('"Throttle"')}, 6) AS "Avg_Throttle",
       round_even({xmean('CAST("Brake" AS INTEGER)')} * 100.0, 6) AS "Brake_Pct",
       round_even({xmean('"RPM"')}, 6) AS "Avg_RPM", round_even(max("RPM"), 6) AS "Max_RPM",
       count(DISTINCT "LapNumber") AS "Laps", count(*) AS "Data_Points"
FROM tel GROUP BY ALL"""))
def q_driver_summary(spark, sf):
    # digits=6 with order-independent means: the library default (1 digit, as
    # in the analysed project) rounds double means whose last bits depend on
    # the summation order, so ties could fall either way between engines.
    return round6(summaries.driver_summary(telemetry_view(spark, sf), digits=None, exact_mean=True), _AG4_FLOATS)


@register("driver_multi_stats", sql(f"""
SELECT {KEYS}, "Driver",
  round_even({xmean('"Throttle"')}, 6) AS "Throttle_mean", round_even(max("Throttle"), 6) AS "Throttle_max",
  round_even(min("Throttle"), 6) AS "Throttle_min",
  round_even({xmean('CAST("Brake" AS INTEGER)')}, 6) AS "Brake_mean", round_even(CAST(max(CAST("Brake" AS INTEGER)) AS DOUBLE), 6) AS "Brake_max",
  round_even({xmean('"Speed"')}, 6) AS "Speed_mean", round_even(max("Speed"), 6) AS "Speed_max",
  round_even({xmean('"RPM"')}, 6) AS "RPM_mean", round_even(max("RPM"), 6) AS "RPM_max"
FROM tel GROUP BY ALL"""))
def q_driver_multi_stats(spark, sf):
    return _r6_all(summaries.multi_stats(telemetry_view(spark, sf), summaries.QUALI_STATS, digits=None, exact_mean=True))


@register("driver_race_stats", sql(f"""
SELECT {KEYS}, "Driver",
  round_even({xmean('"Throttle"')}, 6) AS "Throttle_mean", round_even(max("Throttle"), 6) AS "Throttle_max",
  round_even({xmean('CAST("Brake" AS INTEGER)')}, 6) AS "Brake_mean", round_even(CAST(max(CAST("Brake" AS INTEGER)) AS DOUBLE), 6) AS "Brake_max",
  round_even({xmean('"Speed"')}, 6) AS "Speed_mean", round_even(max("Speed"), 6) AS "Speed_max",
  round_even({xmean('"RPM"')}, 6) AS "RPM_mean", round_even(max("RPM"), 6) AS "RPM_max",
  round_even(CAST(max("LapNumber") AS DOUBLE), 6) AS "LapNumber_max"
FROM tel GROUP BY ALL"""))
def q_driver_race_stats(spark, sf):
    return _r6_all(summaries.multi_stats(telemetry_view(spark, sf), summaries.RACE_STATS, digits=None, exact_mean=True))


@register("driver_deep_dive", sql(f"""
SELECT {KEYS}, "Driver", "Corner", count(*) AS "Data_Points",
       min("Speed") AS "Min_Speed", max("Speed") AS "Max_Speed",
       min("Acceleration") AS "Max_Deceleration", max("Acceleration") AS "Max_Acceleration",
       round({xmean('"Throttle"')}, 6) AS "Avg_Throttle", round({xmean('CAST("Brake" AS INTEGER)')}, 6) AS "Avg_Brake"
FROM proc WHERE "Corner" IS NOT NULL GROUP BY ALL"""))
def q_driver_deep_dive(spark, sf):
    d = summaries.driver_corner_deep_dive(processed(spark, sf), exact_mean=True)
    return d.withColumn("Avg_Throttle", r6("Avg_Throttle")).withColumn("Avg_Brake", r6("Avg_Brake"))


@register("driver_session_deep_dive", sql(f"""
SELECT {KEYS}, "Driver", count(*) AS "Data_Points", max("LapNumber") AS "Laps_Completed",
       round({xmean('"Throttle"')}, 6) AS "Avg_Throttle", max("Throttle") AS "Max_Throttle",
       round({xmean('CAST("Brake" AS INTEGER)')}, 6) AS "Avg_Brake", max(CAST("Brake" AS INTEGER)) AS "Max_Brake",
       round({xmean('"Speed"')}, 6) AS "Avg_Speed", max("Speed") AS "Max_Speed"
FROM tel GROUP BY ALL"""))
def q_driver_session_deep_dive(spark, sf):
    d = summaries.driver_session_deep_dive(telemetry_view(spark, sf), exact_mean=True)
    for c in ("Avg_Throttle", "Avg_Brake", "Avg_Speed"):
        d = d.withColumn(c, r6(c))
    return d


@register("driver_compare", sql(f"""
SELECT {KEYS}, "Driver", "Metric", "Value" FROM (
  SELECT {KEYS}, "Driver",
         round_even(max("Speed"), 6) AS "Max_Speed", round_even({xmean('"Throttle"')}, 6) AS "Avg_Throttle",
         round_even({xmean('CAST("Brake" AS INTEGER)')} * 100.0, 6) AS "Brake_Pct", round_even({xmean('"RPM"')}, 6) AS "Avg_RPM"
  FROM tel GROUP BY ALL)
UNPIVOT ("Value" FOR "Metric" IN ("Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM"))"""))
def q_driver_compare(spark, sf):
    """CH-4: the four comparison metrics of every driver in long form (pick
    drivers by filtering ``Driver``)."""
    s = round6(summaries.driver_summary(telemetry_view(spark, sf), digits=None, exact_mean=True), _AG4_FLOATS)
    return s.unpivot([*S.SESSION_KEYS, "Driver"], ["Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM"],
                     "Metric", "Value")


@register("corner_summary", sql(f"""
SELECT {KEYS}, "Driver", "Corner", min("Speed") AS "Min_Speed",
       min("Acceleration") FILTER (WHERE "Accel_Type" = 'Deceleration') AS "Max_Deceleration",
       max("Acceleration") FILTER (WHERE "Accel_Type" = 'Acceleration') AS "Max_Acceleration_Exit",
       count(*) AS "Data_Points"
FROM proc WHERE "Corner" IS NOT NULL GROUP BY ALL"""))
def q_corner_summary(spark, sf):
    return summaries.corner_summary(processed(spark, sf))


@register("corner_events", sql(f"""
SELECT {KEYS}, "Driver", "Corner", min("Speed") AS "Min_Speed",
       min("Acceleration") AS "Max_Deceleration", max("Acceleration") AS "Max_Acceleration_Exit"
FROM proc WHERE "Corner" IS NOT NULL GROUP BY ALL"""))
def q_corner_events(spark, sf):
    return summaries.corner_events(processed(spark, sf))


CS_SQL = f"""
cs AS (
SELECT {KEYS}, "Driver", "Corner", min("Speed") AS "Min_Speed",
       min("Acceleration") FILTER (WHERE "Accel_Type" = 'Deceleration') AS "Max_Deceleration",
       max("Acceleration") FILTER (WHERE "Accel_Type" = 'Acceleration') AS "Max_Acceleration_Exit",
       count(*) AS "Data_Points"
FROM proc WHERE "Corner" IS NOT NULL GROUP BY ALL)"""


@register("corner_leaders", sql(f"""
SELECT {KEYS}, "Corner", 'Deceleration' AS "Board", "Rank", "Driver", "Max_Deceleration" AS "Value" FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS}, "Corner" ORDER BY "Max_Deceleration", "Driver") AS INTEGER) AS "Rank"
  FROM cs WHERE "Max_Deceleration" IS NOT NULL) WHERE "Rank" <= 10
UNION ALL
SELECT {KEYS}, "Corner", 'Acceleration' AS "Board", "Rank", "Driver", "Max_Acceleration_Exit" AS "Value" FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS}, "Corner" ORDER BY "Max_Acceleration_Exit" DESC, "Driver") AS INTEGER) AS "Rank"
  FROM cs WHERE "Max_Acceleration_Exit" IS NOT NULL) WHERE "Rank" <= 10""", CS_SQL))
def q_corner_leaders(spark, sf):
    return summaries.corner_leaders(processed(spark, sf))


@register("top_decel_events", sql(f"""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY "Max_Deceleration", "Driver", "Corner") AS INTEGER) AS "Rank"
  FROM (SELECT {KEYS}, "Driver", "Corner", min("Speed") AS "Min_Speed",
               min("Acceleration") AS "Max_Deceleration", max("Acceleration") AS "Max_Acceleration_Exit"
        FROM proc WHERE "Corner" IS NOT NULL GROUP BY ALL)
  WHERE "Max_Deceleration" IS NOT NULL) WHERE "Rank" <= 15"""))
def q_top_decel_events(spark, sf):
    return summaries.top_decel_events(processed(spark, sf))


@register("corner_bars", sql(f"""
SELECT {KEYS}, "Driver", "Corner", round_even("Min_Speed", 2) AS "Min_Speed",
       round_even("Max_Deceleration", 2) AS "Max_Deceleration",
       round_even("Max_Acceleration_Exit", 2) AS "Max_Acceleration_Exit", "Data_Points",
       CAST(row_number() OVER (PARTITION BY {KEYS}, "Corner" ORDER BY "Min_Speed", "Driver") AS INTEGER) AS "Speed_Order",
       CASE WHEN "Max_Deceleration" IS NOT NULL THEN CAST(row_number() OVER (
         PARTITION BY {KEYS}, "Corner" ORDER BY "Max_Deceleration" IS NULL, "Max_Deceleration", "Driver") AS INTEGER) END AS "Decel_Order"
FROM cs""", CS_SQL))
def q_corner_bars(spark, sf):
    return summaries.corner_bars(processed(spark, sf))


@register("kpi_counts", sql(f"""
SELECT {KEYS}, count(*) AS "Rows", count(DISTINCT "Driver") AS "Drivers",
       count(DISTINCT "Corner") AS "Corners", count(DISTINCT "LapNumber") AS "Laps"
FROM proc GROUP BY ALL"""))
def q_kpi_counts(spark, sf):
    return summaries.kpi_counts(processed(spark, sf))


@register("distinct_drivers", """
SELECT DISTINCT "Round", "Driver" FROM tel WHERE "Driver" IS NOT NULL""")
def q_distinct_drivers(spark, sf):
    return summaries.distinct_sorted(telemetry_view(spark, sf), ["Round", "Driver"])


@register("distinct_corners", sql("""
SELECT DISTINCT "Corner" FROM proc WHERE "Corner" IS NOT NULL"""))
def q_distinct_corners(spark, sf):
    return summaries.distinct_sorted(processed(spark, sf), ["Corner"])


@register("speed_histogram", f"""
rng AS (SELECT {KEYS}, min("Speed") AS _lo, max("Speed") AS _hi FROM tel WHERE "Speed" IS NOT NULL GROUP BY ALL),
binned AS (
  SELECT t.*, r._lo, r._hi,
         CASE WHEN r._hi = r._lo THEN 0
              ELSE CAST(least(floor((t."Speed" - r._lo) / ((r._hi - r._lo) / 40.0)), 39) AS INTEGER) END AS "Bin"
  FROM tel t JOIN rng r USING ({KEYS}) WHERE t."Speed" IS NOT NULL)
---
SELECT {KEYS}, "Bin", count(*) AS "Count", round(any_value(_lo) + "Bin" * (any_value(_hi) - any_value(_lo)) / 40.0, 6) AS "Bin_Lo"
FROM binned GROUP BY {KEYS}, "Bin"
""")
def q_speed_histogram(spark, sf):
    h = summaries.histogram(telemetry_view(spark, sf), "Speed", 40)
    return h.withColumn("Bin_Lo", r6("Bin_Lo"))


@register("rpm_histogram", f"""
rng AS (SELECT {KEYS}, min("RPM") AS _lo, max("RPM") AS _hi FROM tel WHERE "RPM" IS NOT NULL GROUP BY ALL),
binned AS (
  SELECT t.*, r._lo, r._hi,
         CASE WHEN r._hi = r._lo THEN 0
              ELSE CAST(least(floor((t."RPM" - r._lo) / ((r._hi - r._lo) / 40.0)), 39) AS INTEGER) END AS "Bin"
  FROM tel t JOIN rng r USING ({KEYS}) WHERE t."RPM" IS NOT NULL)
---
SELECT {KEYS}, "Bin", count(*) AS "Count", round(any_value(_lo) + "Bin" * (any_value(_hi) - any_value(_lo)) / 40.0, 6) AS "Bin_Lo"
FROM binned GROUP BY {KEYS}, "Bin"
""")
def q_rpm_histogram(spark, sf):
    h = summaries.histogram(telemetry_view(spark, sf), "RPM", 40)
    return h.withColumn("Bin_Lo", r6("Bin_Lo"))


@register("gear_counts", """
SELECT p_size AS "Gear", count(*) AS "Count" FROM part GROUP BY ALL""", adapter=False)
def q_gear_counts(spark, sf):
    """AG-20 categorical histogram; gear := p_size of part."""
    return summaries.category_counts(read_table(spark, sf, "part").select(F.col("p_size").alias("Gear")), "Gear")


@register("dedupe_first", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
       arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS o_orderdate,
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey""", adapter=False)
def q_dedupe_first(spark, sf):
    """AG-19: first order of every customer (explicit order: date, key)."""
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return summaries.dedupe_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@register("head_per_key", sql(f"""
SELECT * FROM (
  SELECT {KEYS}, "Driver", "Corner", sample_id, "TimeInLap", "Speed", "Throttle", "Brake", "Acceleration", "Accel_Type",
         CAST(row_number() OVER (PARTITION BY {KEYS}, "Driver", "Corner" ORDER BY "TimeInLap", sample_id) AS INTEGER) AS "RowInKey"
  FROM proc WHERE "Corner" IS NOT NULL) WHERE "RowInKey" <= 5"""))
def q_head_per_key(spark, sf):
    """TK-6: five samples per driver and corner in time order."""
    p = processed(spark, sf).filter(F.col("Corner").isNotNull())
    h = summaries.head_per_key(p, [*S.SESSION_KEYS, "Driver", "Corner"], 5)
    return h.select(*S.SESSION_KEYS, "Driver", "Corner", "sample_id", "TimeInLap", "Speed", "Throttle", "Brake",
                    "Acceleration", "Accel_Type", "RowInKey")


@register("processed_telemetry", sql(f"""
SELECT {KEYS}, "DriverNumber", "Driver", "LapNumber", sample_id, "TimeInLap", "Speed", "X", "Y",
       "Corner", "Speed_ms", "Acceleration", "Accel_Type" FROM proc"""))
def q_processed_telemetry(spark, sf):
    """PL-1: corner tagging + acceleration on every sample."""
    p = processed(spark, sf)
    return p.select(*S.SESSION_KEYS, "DriverNumber", "Driver", "LapNumber", "sample_id", "TimeInLap", "Speed",
                    "X", "Y", "Corner", "Speed_ms", "Acceleration", "Accel_Type")


@register("canonical_projection", """
SELECT "Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber", "TimeInLap", "Throttle", "Brake",
       "RPM", "Speed", "X", "Y", "LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "Compound", sample_id
FROM tel""")
def q_canonical_projection(spark, sf):
    """PRJ-1: canonical column order over the telemetry view (present columns only)."""
    from trackside.sources.files import canonical_order
    return canonical_order(telemetry_view(spark, sf), extra=["sample_id"])


@register("preview_rows", """
SELECT "Year", "Round", "SessionType", "DriverNumber", "LapNumber", "TimeInLap", sample_id, "Speed" FROM tel
ORDER BY "Year", "Round", "SessionType", "DriverNumber", "LapNumber", "TimeInLap" NULLS LAST, sample_id
LIMIT 1799""")
def q_preview_rows(spark, sf):
    """SNK-2: the 1,800-line preview (1,799 rows) in explicit sample order."""
    from trackside.sources.sinks import preview
    return preview(telemetry_view(spark, sf)).select("Year", "Round", "SessionType", "DriverNumber", "LapNumber",
                                                     "TimeInLap", "sample_id", "Speed")
