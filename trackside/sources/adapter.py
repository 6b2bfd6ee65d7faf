"""Telemetry-shaped view over the driver's ``events`` table.

The test tables hold no car telemetry, so every telemetry operator is run on
this view (one definition for Spark, mirrored by ``ADAPTER_SQL`` for DuckDB):

* Year 2024, Round = user_id % 4, SessionType 'Q'; Driver = DriverNumber = user_id
* LapNumber = (day of month - 1) div 10  (0, 1, 2)
* TimeInLap = hours since the lap's first event, used as seconds
* Speed = value, Throttle = props.k, RPM = 9000 + 10*value,
  Brake = event_type = 'error', X = k*30 - 1000, Y = value*15 - 1600
* LapTime = duration text of the lap's last TimeInLap (null for one-sample laps
  and for lap 2 of every 7th user); Sector1..3Time split the lap at 80 s and
  160 s (null when the sector holds no sample); laps of users with
  user_id % 3 = 1 use the short text shape ``H:MM:SS.ffffff``
* Compound = most frequent event_type of the lap, ties alphabetical
* sample_id = event_id (tie-break for equal TimeInLap)

The view reads the whole table; its size grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.durations import duration_text
from trackside.operators.common import dealt_by_lap

HOUR_US = 3600000000
SECTOR1_END_US = 80 * HOUR_US
SECTOR2_END_US = 160 * HOUR_US
EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def telemetry_from_events(events: DataFrame, *, dealt: bool = False) -> DataFrame:
    """The view; with ``dealt``, partitioned by lap into tasks of bounded size (``dealt_by_lap``)."""
    lap_keys = S.LAP_KEYS
    base = events.select(
        F.lit(2024).alias("Year"),
        F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("Round"),
        F.lit("Q").alias("SessionType"),
        F.col("user_id").cast("string").alias("DriverNumber"),
        F.col("user_id").cast("string").alias("Driver"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("LapNumber"),
        F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)").alias("_us"),
        F.col("event_id").alias(S.SAMPLE_ID),
        F.get_json_object("props", "$.k").cast("double").alias("Throttle"),
        (F.col("event_type") == "error").alias("Brake"),
        (F.lit(9000.0) + F.col("value") * 10.0).alias("RPM"),
        F.col("value").alias("Speed"),
        (F.get_json_object("props", "$.k").cast("double") * 30.0 - 1000.0).alias("X"),
        (F.col("value") * 15.0 - 1600.0).alias("Y"),
        F.col("event_type").alias("_etype"),
        (F.pmod(F.col("user_id"), F.lit(3)) == 1).alias("_short"),
        ((F.floor((F.dayofmonth("ts") - 1) / 10) == 2)
         & (F.pmod(F.col("user_id"), F.lit(7)) == 0)).alias("_no_laptime"),
    )
    if dealt:
        # by the columns that are not constant here, else the windows do not use this exchange
        base = dealt_by_lap(base, ["Round", S.DRIVER_COL, S.LAP_COL], events.count())
    w_lap = Window.partitionBy(*lap_keys)
    d = F.col("_us") - F.min("_us").over(w_lap)
    base = base.withColumn("_d", d)
    lap_d = F.max("_d").over(w_lap)
    s1 = F.max(F.when(F.col("_d") <= SECTOR1_END_US, F.col("_d"))).over(w_lap)
    s2_end = F.max(F.when(F.col("_d") <= SECTOR2_END_US, F.col("_d"))).over(w_lap)
    has_s2 = F.max(F.when((F.col("_d") > SECTOR1_END_US) & (F.col("_d") <= SECTOR2_END_US), 1)).over(w_lap)
    has_s3 = F.max(F.when(F.col("_d") > SECTOR2_END_US, 1)).over(w_lap)
    base = base.select(
        "*",
        lap_d.alias("_lap_d"), s1.alias("_s1"), s2_end.alias("_s2e"),
        has_s2.alias("_has_s2"), has_s3.alias("_has_s3"),
        F.count(F.lit(1)).over(Window.partitionBy(*lap_keys, "_etype")).alias("_n_type"),
    )
    compound = F.min_by(F.col("_etype"), F.struct(-F.col("_n_type"), F.col("_etype"))).over(w_lap)

    # "seconds" of text = hours of real time -> micro-"seconds" = d / 3600 (rounded)
    def text_us(c):
        return F.floor((c + F.lit(1800)) / F.lit(3600)).cast("long")

    short = F.col("_short")
    return base.select(
        "Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber",
        (F.col("_d") / F.lit(float(HOUR_US))).alias("TimeInLap"),
        "Throttle", "Brake", "RPM", "Speed", "X", "Y",
        F.when(~F.col("_no_laptime") & (F.col("_lap_d") > 0),
               duration_text(text_us(F.col("_lap_d")), short)).alias("LapTime"),
        F.when(F.col("_s1") > 0, duration_text(text_us(F.col("_s1")), short)).alias("Sector1Time"),
        F.when(F.col("_has_s2") == 1,
               duration_text(text_us(F.col("_s2e") - F.col("_s1")), short)).alias("Sector2Time"),
        F.when(F.col("_has_s3") == 1,
               duration_text(text_us(F.col("_lap_d") - F.col("_s2e")), short)).alias("Sector3Time"),
        compound.alias("Compound"),
        S.SAMPLE_ID,
    )


def telemetry_view(spark: SparkSession, sf_dir: str, *, dealt: bool = False) -> DataFrame:
    """The adapter view for the tables under ``sf_dir``."""
    return telemetry_from_events(read_table(spark, sf_dir, "events"), dealt=dealt)


# --------------------------------------------------------------------------- #
# The same view for the DuckDB oracle (a CTE named ``tel``).
# --------------------------------------------------------------------------- #
def _dt(expr: str, short: str) -> str:
    us = f"(({expr}) + 1800) // 3600"
    long_t = (f"printf('%d days %02d:%02d:%02d.%06d', ({us}) // 86400000000, (({us}) // 3600000000) % 24, "
              f"(({us}) // 60000000) % 60, (({us}) // 1000000) % 60, ({us}) % 1000000)")
    short_t = (f"printf('%d:%02d:%02d.%06d', ({us}) // 3600000000, "
               f"(({us}) // 60000000) % 60, (({us}) // 1000000) % 60, ({us}) % 1000000)")
    return f"CASE WHEN {short} THEN {short_t} ELSE {long_t} END"


ADAPTER_SQL = f"""
tel_base AS (
  SELECT 2024 AS "Year", CAST(user_id % 4 AS INTEGER) AS "Round", 'Q' AS "SessionType",
         CAST(user_id AS VARCHAR) AS "DriverNumber", CAST(user_id AS VARCHAR) AS "Driver",
         CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS "LapNumber",
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS _us,
         event_id AS sample_id,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS "Throttle",
         event_type = 'error' AS "Brake",
         9000.0 + value * 10.0 AS "RPM", value AS "Speed",
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 30.0 - 1000.0 AS "X",
         value * 15.0 - 1600.0 AS "Y",
         event_type AS _etype, user_id % 3 = 1 AS _short,
         (floor((day(ts) - 1) / 10) = 2 AND user_id % 7 = 0) AS _no_laptime
  FROM events
),
tel_d AS (
  SELECT *, _us - min(_us) OVER (PARTITION BY "Year", "Round", "SessionType", "Driver", "LapNumber") AS _d
  FROM tel_base
),
tel_lap AS (
  SELECT "Year", "Round", "SessionType", "Driver", "LapNumber",
         max(_d) AS _lap_d,
         max(CASE WHEN _d <= {SECTOR1_END_US} THEN _d END) AS _s1,
         max(CASE WHEN _d <= {SECTOR2_END_US} THEN _d END) AS _s2e,
         max(CASE WHEN _d > {SECTOR1_END_US} AND _d <= {SECTOR2_END_US} THEN 1 END) AS _has_s2,
         max(CASE WHEN _d > {SECTOR2_END_US} THEN 1 END) AS _has_s3
  FROM tel_d GROUP BY ALL
),
tel_cmp AS (
  SELECT "Year", "Round", "SessionType", "Driver", "LapNumber",
         first(_etype ORDER BY n DESC, _etype) AS "Compound"
  FROM (SELECT "Year", "Round", "SessionType", "Driver", "LapNumber", _etype, count(*) AS n
        FROM tel_d GROUP BY ALL) GROUP BY ALL
),
tel AS (
  SELECT d."Year", d."Round", d."SessionType", d."DriverNumber", d."Driver", d."LapNumber",
         d._d / {float(HOUR_US)} AS "TimeInLap",
         d."Throttle", d."Brake", d."RPM", d."Speed", d."X", d."Y",
         CASE WHEN NOT d._no_laptime AND l._lap_d > 0 THEN {_dt('l._lap_d', 'd._short')} END AS "LapTime",
         CASE WHEN l._s1 > 0 THEN {_dt('l._s1', 'd._short')} END AS "Sector1Time",
         CASE WHEN l._has_s2 = 1 THEN {_dt('l._s2e - l._s1', 'd._short')} END AS "Sector2Time",
         CASE WHEN l._has_s3 = 1 THEN {_dt('l._lap_d - l._s2e', 'd._short')} END AS "Sector3Time",
         c."Compound", d.sample_id
  FROM tel_d d
  JOIN tel_lap l USING ("Year", "Round", "SessionType", "Driver", "LapNumber")
  JOIN tel_cmp c USING ("Year", "Round", "SessionType", "Driver", "LapNumber")
)"""
