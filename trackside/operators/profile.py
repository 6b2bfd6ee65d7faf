"""Lap distance percentage, speed/brake profiles, lap scalars, sector ratios
(WN-2, AG-11..14, JN-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.durations import parsable_duration, parse_duration_seconds
from trackside.functions.exprs import brake_numeric
from trackside.operators.common import mean, sample_order, with_group_stats
from trackside.operators.sequence import lap_scan


def step_distance(prev) -> Column:
    """sqrt(dX^2 + dY^2) to the previous sample; null (first sample, missing X/Y) -> 0 (T15)."""
    dx = F.col("X") - prev["X"]
    dy = F.col("Y") - prev["Y"]
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def lap_pct_column() -> Column:
    """LapPct from the scan outputs ``_cum``, ``_cum_lap_total``, ``_last_TimeInLap``, ``_n``."""
    return (F.when(F.col("_cum_lap_total") > 0, F.col("_cum") / F.col("_cum_lap_total") * 100.0)
            .when((F.col("_n") > 1) & (F.col(f"_last_{S.TIME_COL}") > 0),
                  F.col(S.TIME_COL) / F.col(f"_last_{S.TIME_COL}") * 100.0)
            .otherwise(F.lit(0.0)))


SCAN_TMP = ["_cum", "_cum_lap_total", f"_last_{S.TIME_COL}", "_n", "_prev_X", "_prev_Y"]


def add_lap_pct(df: DataFrame, *, lap_keys: list[str] = S.LAP_KEYS) -> DataFrame:
    """WN-2: cumulative XY distance as 0-100 % of the lap.

    step = sqrt(dX^2 + dY^2) vs the previous sample (null -> 0, T15); LapPct =
    cum/total*100 when total > 0, else TimeInLap/last TimeInLap*100 when the lap
    has > 1 sample and last TimeInLap > 0, else 0. ``total`` is the last running
    value, so the last sample is exactly 100. One ordered scan per lap
    (``operators.sequence.lap_scan``).
    """
    has_xy = "X" in df.columns and "Y" in df.columns
    out = lap_scan(df, keys=lap_keys, time_col=S.TIME_COL, tie_col=S.SAMPLE_ID,
                   lags=["X", "Y"] if has_xy else [],
                   running={"_cum": step_distance if has_xy else (lambda prev: F.lit(0.0))},
                   lap_totals=True, lap_last=[S.TIME_COL], lap_count="_n")
    return out.withColumn("LapPct", lap_pct_column()).drop(*[c for c in SCAN_TMP if c in out.columns])


def lap_profile_aggs(df: DataFrame, exact_mean: bool = False) -> list:
    """AG-12 + AG-13 aggregate expressions over samples carrying LapPct."""
    b = brake_numeric("Brake", df.schema["Brake"].dataType)
    pct = F.col("LapPct")
    out = []
    for p in S.SPEED_PCT_POINTS:
        cond = (pct >= p - S.SPEED_PCT_HALF_WIDTH) & (pct < p + S.SPEED_PCT_HALF_WIDTH)
        out.append(mean(F.when(cond, F.col("Speed")), exact_mean).alias(f"Speed_Pct_{p}"))
    for label, lo, hi in S.BRAKE_THIRDS:
        cond = (pct >= lo) & (pct < hi)
        out.append((mean(F.when(cond, b), exact_mean) * 100.0).alias(label))
    return out


def lap_scalar_aggs(df: DataFrame, exact_mean: bool = False) -> list:
    """AG-11 aggregate expressions (Brake_Time_Pct needs the zones, see features)."""
    b = brake_numeric("Brake", df.schema["Brake"].dataType)
    order = sample_order(df)
    return [
        mean("Speed", exact_mean).alias("Avg_Speed"), F.max("Speed").alias("Max_Speed"),
        mean("Throttle", exact_mean).alias("Avg_Throttle"),
        (mean(b, exact_mean) * 100.0).alias("Brake_Pct"),
        mean("RPM", exact_mean).alias("Avg_RPM"),
        (F.max_by(S.TIME_COL, order) - F.min_by(S.TIME_COL, order)).alias("_lap_time"),
        F.count(F.lit(1)).alias("_samples"),
    ]


def sector_text_aggs(order: Column) -> list:
    """Per group of samples: the first parsable text of each sector, as (order, text)."""
    return [F.min(F.when(parsable_duration(f"Sector{i}Time"), F.struct(order.alias("o"), F.col(f"Sector{i}Time").alias("t"))))
            .alias(f"_st{i}") for i in (1, 2, 3)]


def sector_driver_aggs() -> list:
    """Per driver, over laps with S1..S3 in seconds: the sectors of the lap with the least
    S1+S2+S3 (null sectors count 0, ties to the lowest LapNumber) and the least of each sector."""
    tot = sum((F.coalesce(F.col(f"S{i}"), F.lit(0.0)) for i in (2, 3)), F.coalesce(F.col("S1"), F.lit(0.0)))
    return [F.min_by(F.struct("S1", "S2", "S3"), F.struct(tot, F.col(S.LAP_COL))).alias("_sectors"),
            *[F.min(f"S{i}").alias(f"_dmin{i}") for i in (1, 2, 3)]]


def add_sector_ratios(per_driver: DataFrame, keys: list[str]) -> DataFrame:
    """JN-8 on a per-driver table with ``sector_driver_aggs``: each sector over the session's best
    (a partial minimum joined back); null unless that best is > 0."""
    out = with_group_stats(per_driver, list(keys), [F.min(f"_dmin{i}").alias(f"_best{i}") for i in (1, 2, 3)])
    ratios = [F.when(F.col(f"_best{i}") > 0, F.col(f"_sectors.S{i}") / F.col(f"_best{i}")).alias(f"Sector{i}_Ratio")
              for i in (1, 2, 3)]
    drop = {"_sectors", *[f"{p}{i}" for p in ("_dmin", "_best") for i in (1, 2, 3)]}
    return out.select(*[c for c in out.columns if c not in drop], *ratios)


def sector_ratios(session_df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """AG-14 + JN-8: per (session, driver): the sectors of the driver's lap with the least
    S1+S2+S3, each divided by the session's best sector."""
    # first parsable text per lap (one regex match per sample), parsed once per lap
    per_lap = (session_df.filter(F.col(S.DRIVER_COL).isNotNull()).groupBy(*keys, S.DRIVER_COL, S.LAP_COL)
               .agg(*sector_text_aggs(sample_order(session_df))))
    per_lap = per_lap.select(*keys, S.DRIVER_COL, S.LAP_COL,
                             *[parse_duration_seconds(f"_st{i}.t").alias(f"S{i}") for i in (1, 2, 3)])
    per_driver = per_lap.groupBy(*keys, S.DRIVER_COL).agg(*sector_driver_aggs())
    out = add_sector_ratios(per_driver, list(keys))
    return out.select(*keys, S.DRIVER_COL, "Sector1_Ratio", "Sector2_Ratio", "Sector3_Ratio")
