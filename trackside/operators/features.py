"""Driving-style features (PL-3, PL-4), per-round z-scores (WN-6) and the driver
feature matrix (AG-15, PL-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.durations import parse_duration_seconds
from trackside.operators.common import dealt_by_lap, with_group_stats
from trackside.operators.laps import with_laptime_seconds
from trackside.operators.profile import add_sector_ratios, sector_driver_aggs, sector_text_aggs


ZONE_COLS = ["Mean_Entry_Speed", "Mean_Apex_Speed", "Mean_Exit_Speed", "Mean_Brake_Duration",
             "Std_Brake_Duration", "Mean_Peak_Decel", "Max_Peak_Decel"]


def round_driver_features(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                          min_lap_samples: int = S.MIN_FASTEST_LAP_SAMPLES,
                          min_feature_samples: int = S.MIN_LAP_FEATURE_SAMPLES,
                          exact_mean: bool = False, dealt: bool = False) -> DataFrame:
    """PL-4: style features of each driver's fastest lap (ties to the lowest LapNumber), for
    every session in one plan. The fastest lap must hold >= ``min_lap_samples`` samples.

    One pass over the samples makes the lap table; one aggregate over it picks the fastest
    lap's features and the driver's sectors; the session's best sectors are joined back. The samples
    are counted and dealt by lap into tasks of bounded size first, unless they are ``dealt`` already."""
    # laps without a driver or number can never be a driver's fastest lap
    work = with_laptime_seconds(df).filter(F.col(S.DRIVER_COL).isNotNull() & F.col(S.LAP_COL).isNotNull())
    if not dealt:
        work = dealt_by_lap(work, [*keys, S.DRIVER_COL, S.LAP_COL], df.count())
    parts = all_lap_features(work, keys=keys, exact_mean=exact_mean)
    fcols = [c for c in S.STYLE_FEATURE_COLUMNS if not c.startswith("Sector")]
    timed = F.when(F.col("_timed"), F.struct("LapTime_seconds", S.LAP_COL, "_samples", *fcols))
    laps = parts.groupBy(*keys, S.DRIVER_COL, S.LAP_COL).agg(
        F.first(timed, ignorenulls=True).alias("_lap"), *[F.min(f"_st{i}").alias(f"_st{i}") for i in (1, 2, 3)])
    laps = laps.select(*keys, S.DRIVER_COL, S.LAP_COL, "_lap",
                       *[parse_duration_seconds(f"_st{i}.t").alias(f"S{i}") for i in (1, 2, 3)])
    fastest = F.when(F.col("_lap").isNotNull(), F.struct("_lap.LapTime_seconds", S.LAP_COL))
    per_driver = laps.groupBy(*keys, S.DRIVER_COL).agg(F.min_by("_lap", fastest).alias("_f"), *sector_driver_aggs())
    out = add_sector_ratios(per_driver, list(keys)).filter(
        F.col("_f._samples") >= max(min_lap_samples, min_feature_samples))
    out = out.select(*keys, S.DRIVER_COL, *[F.col(f"_f.{c}").alias(c) for c in fcols],
                     *[f"Sector{i}_Ratio" for i in (1, 2, 3)])
    return out.select(*keys, S.DRIVER_COL, *[F.col(c).cast("double").alias(c) for c in S.STYLE_FEATURE_COLUMNS])


def zscore_within_round(features: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                        cols: list[str] | None = None) -> DataFrame:
    """WN-6: z-score each feature within its session using the sample std.

    A column whose std is null or 0, or whose min equals its max, becomes 0.0
    for every row (null cells included); otherwise nulls stay null. The
    statistics are one partial aggregate per session over the materialised
    per-driver table, joined back on the keys (no task holds a whole session).
    """
    cols = [c for c in (cols or S.STYLE_FEATURE_COLUMNS) if c in features.columns]
    rest = [c for c in features.columns if c not in cols]
    src = with_group_stats(features, list(keys), [e for c in cols for e in (
        F.avg(c).alias(f"_mu_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"),
        F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    out = []
    for c in cols:
        sd, mu = F.col(f"_sd_{c}"), F.col(f"_mu_{c}")
        const = sd.isNull() | (sd == 0) | (F.col(f"_lo_{c}") == F.col(f"_hi_{c}"))
        out.append(F.when(const, F.lit(0.0)).otherwise((F.col(c) - mu) / sd).alias(c))
    return src.select(*rest, *out)


def driver_feature_matrix(per_round: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                          cols: list[str] | None = None) -> DataFrame:
    """PL-5 / AG-15: z-score within each session, then average per driver."""
    cols = [c for c in (cols or S.STYLE_FEATURE_COLUMNS) if c in per_round.columns]
    z = zscore_within_round(per_round, keys=keys, cols=cols)
    return z.groupBy(S.DRIVER_COL).agg(*[F.avg(c).alias(c) for c in cols])


def _sum(c, exact: bool):
    return F.sum(c.cast("decimal(38,18)")) if exact else F.sum(c)


def _ratio(s, n):
    return F.when(n > 0, s.cast("double") / n.cast("double"))


def all_lap_features(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                     exact_mean: bool = False) -> DataFrame:
    """PL-3 for every lap of ``df`` in one pass over the samples: one row per lap and
    ``_timed`` (samples with and without a parsed lap time are described apart).

    Samples are marked (zones, LapPct) with per-lap windows, then aggregated
    once per (lap, zone, braking flag) and once more per lap from those
    partials; both aggregations reuse the window partitioning (no exchange).
    Adds ``LapTime_seconds`` (lap minimum) and ``_samples`` per lap; the sector
    texts are kept as ``_st1..3`` (their ratios are per driver, see ``add_sector_ratios``).
    """
    from trackside.functions.exprs import brake_numeric
    from trackside.operators.common import sample_order

    lap_keys = list(keys) + [S.DRIVER_COL, S.LAP_COL, "_timed"]
    m = zones_and_lap_pct(df.withColumn("_timed", F.col("LapTime_seconds").isNotNull()), lap_keys=lap_keys)
    order = sample_order(m)
    b = brake_numeric("Brake", m.schema["Brake"].dataType)
    speed, pct = F.col("Speed"), F.col("LapPct")
    prof = []
    for p in S.SPEED_PCT_POINTS:
        cond = (pct >= p - S.SPEED_PCT_HALF_WIDTH) & (pct < p + S.SPEED_PCT_HALF_WIDTH)
        v = F.when(cond, speed)
        prof += [_sum(v, exact_mean).alias(f"_ps{p}"), F.count(v).alias(f"_pn{p}")]
    for label, lo, hi in S.BRAKE_THIRDS:
        v = F.when((pct >= lo) & (pct < hi), b)
        prof += [_sum(v, exact_mean).alias(f"_ts_{label}"), F.count(v).alias(f"_tn_{label}")]
    g = m.groupBy(*lap_keys, "zone_id", "_braking").agg(
        F.count(F.lit(1)).alias("_n"),
        _sum(speed, exact_mean).alias("_ss"), F.count(speed).alias("_sn"), F.max(speed).alias("_smax"),
        _sum(F.col("Throttle"), exact_mean).alias("_ths"), F.count("Throttle").alias("_thn"),
        _sum(b, exact_mean).alias("_bs"), F.count(b).alias("_bn"),
        _sum(F.col("RPM"), exact_mean).alias("_rs"), F.count("RPM").alias("_rn"),
        F.min(order).alias("_o1"), F.max(order).alias("_o2"),
        F.min_by(S.TIME_COL, order).alias("_t1"), F.max_by(S.TIME_COL, order).alias("_t2"),
        F.min_by("Speed", order).alias("_entry"), F.max_by("Speed", order).alias("_exit"),
        F.min("Speed").alias("_apex"),
        F.min(F.when(F.col("Acceleration") < S.ZONE_PEAK_DECEL_THRESHOLD, F.col("Acceleration"))).alias("_pk"),
        F.min("LapTime_seconds").alias("_lt"),
        *sector_text_aggs(order), *prof)
    dur = F.col("_t2") - F.col("_t1")
    kept = F.col("_braking") & (dur >= S.MIN_BRAKE_ZONE_DURATION)
    peak = F.coalesce(F.col("_pk"), F.lit(0.0))
    lap = g.groupBy(*lap_keys).agg(
        _ratio(F.sum("_ss"), F.sum("_sn")).alias("Avg_Speed"), F.max("_smax").alias("Max_Speed"),
        _ratio(F.sum("_ths"), F.sum("_thn")).alias("Avg_Throttle"),
        (_ratio(F.sum("_bs"), F.sum("_bn")) * 100.0).alias("Brake_Pct"),
        _ratio(F.sum("_rs"), F.sum("_rn")).alias("Avg_RPM"),
        (F.max_by("_t2", "_o2") - F.min_by("_t1", "_o1")).alias("_lap_time"),
        F.sum("_n").alias("_samples"), F.min("_lt").alias("LapTime_seconds"),
        F.count(F.when(kept, 1)).cast("double").alias("Brake_Zones"),
        F.avg(F.when(kept, F.col("_entry"))).alias("Mean_Entry_Speed"),
        F.avg(F.when(kept, F.col("_apex"))).alias("Mean_Apex_Speed"),
        F.avg(F.when(kept, F.col("_exit"))).alias("Mean_Exit_Speed"),
        F.avg(F.when(kept, dur)).alias("Mean_Brake_Duration"),
        F.stddev_pop(F.when(kept, dur)).alias("Std_Brake_Duration"),
        F.avg(F.when(kept, peak)).alias("Mean_Peak_Decel"),
        F.min(F.when(kept, peak)).alias("Max_Peak_Decel"),
        F.coalesce(F.sum(F.when(kept, dur)), F.lit(0.0)).alias("_brake_time"),
        *[F.min(f"_st{i}").alias(f"_st{i}") for i in (1, 2, 3)],
        *[_ratio(F.sum(f"_ps{p}"), F.sum(f"_pn{p}")).alias(f"Speed_Pct_{p}") for p in S.SPEED_PCT_POINTS],
        *[(_ratio(F.sum(f"_ts_{t[0]}"), F.sum(f"_tn_{t[0]}")) * 100.0).alias(t[0]) for t in S.BRAKE_THIRDS])
    return lap.withColumn("Brake_Time_Pct", F.when(F.col("_lap_time") > 0,
                                                   F.col("_brake_time") / F.col("_lap_time") * 100.0)
                          .otherwise(F.lit(0.0)))


def zones_and_lap_pct(df: DataFrame, *, lap_keys: list[str]) -> DataFrame:
    """WN-4 step 1 and WN-2 in one ordered scan per lap (one exchange)."""
    from trackside.operators.profile import SCAN_TMP, lap_pct_column, step_distance
    from trackside.operators.sequence import lap_scan
    from trackside.operators.zones import braking_flag, zone_start
    has_xy = "X" in df.columns and "Y" in df.columns
    x = df.withColumn("_braking", braking_flag(df))
    x = lap_scan(x, keys=lap_keys, time_col=S.TIME_COL, tie_col=S.SAMPLE_ID,
                 lags=["_braking"] + (["X", "Y"] if has_xy else []),
                 running={"zone_id": zone_start,
                          "_cum": step_distance if has_xy else (lambda prev: F.lit(0.0))},
                 lap_totals=True, lap_last=[S.TIME_COL], lap_count="_n")
    return (x.withColumn("LapPct", lap_pct_column())
            .drop("_prev__braking", "zone_id_lap_total", *[c for c in SCAN_TMP if c in x.columns]))
