"""Braking zones as gaps-and-islands (SC-18, WN-4, AG-9, AG-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.exprs import brake_numeric
from trackside.operators.common import sample_order
from trackside.operators.sequence import lap_scan


def braking_flag(df: DataFrame, decel_threshold: float = S.DECEL_THRESHOLD) -> Column:
    """SC-18: brake on, or acceleration below the threshold (null acceleration = no)."""
    b = brake_numeric("Brake", df.schema["Brake"].dataType)
    acc = F.coalesce(F.col("Acceleration") < decel_threshold, F.lit(False)) \
        if "Acceleration" in df.columns else F.lit(False)
    return (b == 1) | acc


def mark_zones(df: DataFrame, *, lap_keys: list[str] = S.LAP_KEYS,
               decel_threshold: float = S.DECEL_THRESHOLD) -> DataFrame:
    """WN-4 step 1: ``_braking`` flag and ``zone_id`` (running count of run starts,
    a run start being a braking sample whose previous sample is not braking) on
    every sample; zone_id is meaningful only where ``_braking``."""
    out = df.withColumn("_braking", braking_flag(df, decel_threshold))
    out = lap_scan(out, keys=lap_keys, time_col=S.TIME_COL, tie_col=S.SAMPLE_ID, lags=["_braking"],
                   running={"zone_id": zone_start})
    return out.drop("_prev__braking")


def zone_start(prev) -> Column:
    """1 where a braking run starts (previous sample not braking), else 0."""
    return (F.col("_braking") & ~F.coalesce(prev["_braking"], F.lit(False))).cast("long")


def zone_features(marked: DataFrame, *, lap_keys: list[str] = S.LAP_KEYS,
                  min_duration: float = S.MIN_BRAKE_ZONE_DURATION,
                  peak_threshold: float = S.ZONE_PEAK_DECEL_THRESHOLD) -> DataFrame:
    """AG-9: one row per kept zone: entry (first) / apex (min) / exit (last) speed,
    duration (last - first TimeInLap, kept when >= min_duration) and peak
    deceleration (min Acceleration below ``peak_threshold``, else 0.0)."""
    order = sample_order(marked)
    z = (marked.filter(F.col("_braking"))
         .groupBy(*lap_keys, "zone_id")
         .agg(F.min_by("Speed", order).alias("entry_speed"),
              F.min("Speed").alias("apex_speed"),
              F.max_by("Speed", order).alias("exit_speed"),
              (F.max_by(S.TIME_COL, order) - F.min_by(S.TIME_COL, order)).alias("duration"),
              F.coalesce(F.min(F.when(F.col("Acceleration") < peak_threshold, F.col("Acceleration"))),
                         F.lit(0.0)).alias("peak_decel"),
              F.count(F.lit(1)).alias("samples")))
    return z.filter(F.col("duration") >= min_duration)


def braking_zones(df: DataFrame, *, lap_keys: list[str] = S.LAP_KEYS, **kw) -> DataFrame:
    """WN-4 + AG-9 on telemetry with Acceleration."""
    return zone_features(mark_zones(df, lap_keys=lap_keys), lap_keys=lap_keys, **kw)


def lap_zone_stats(zones: DataFrame, *, lap_keys: list[str] = S.LAP_KEYS) -> DataFrame:
    """AG-10: per lap: zone count, means of entry/apex/exit/duration, population std
    of duration, mean and min of peak deceleration, and the summed duration."""
    return zones.groupBy(*lap_keys).agg(
        F.count(F.lit(1)).alias("Brake_Zones"),
        F.avg("entry_speed").alias("Mean_Entry_Speed"),
        F.avg("apex_speed").alias("Mean_Apex_Speed"),
        F.avg("exit_speed").alias("Mean_Exit_Speed"),
        F.avg("duration").alias("Mean_Brake_Duration"),
        F.stddev_pop("duration").alias("Std_Brake_Duration"),
        F.avg("peak_decel").alias("Mean_Peak_Decel"),
        F.min("peak_decel").alias("Max_Peak_Decel"),
        F.sum("duration").alias("Brake_Time"),
    )
