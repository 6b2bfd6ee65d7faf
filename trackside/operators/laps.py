"""Lap tables, fastest laps and classification (AG-1..3, FLT-1, JN-11, WN-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.durations import parsable_duration, parse_duration_seconds
from trackside.operators.common import drop_null_keys, first_non_null, rank_by_bucket, sample_order, with_group_stats

LAP_ATTRS = ["LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "Compound", "FreshTyre"]


def _is_numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("double", "float", "int", "bigint") or \
        df.schema[col].dataType.simpleString().startswith("decimal")


def with_laptime_seconds(df: DataFrame, col: str = "LapTime",
                         out: str = "LapTime_seconds") -> DataFrame:
    """SC-1 applied to a duration column (numeric columns pass through as seconds)."""
    if out in df.columns:
        return df
    dtype = df.schema[col].dataType.simpleString()
    if dtype in ("double", "float", "int", "bigint", "decimal"):
        return df.withColumn(out, F.col(col).cast("double"))
    return df.withColumn(out, parse_duration_seconds(col))


def lap_table(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
              attrs: list[str] | None = None) -> DataFrame:
    """AG-1: one row per (keys, Driver, LapNumber); each attribute is its first
    non-null value in sample order. Adds ``*_seconds`` for the duration columns."""
    attrs = [a for a in (attrs or LAP_ATTRS) if a in df.columns]
    order = sample_order(df)
    grp = keys + [S.DRIVER_COL, S.LAP_COL]
    out = (drop_null_keys(df, [S.DRIVER_COL, S.LAP_COL])
           .groupBy(*grp)
           .agg(*[first_non_null(a, order).alias(a) for a in attrs],
                F.count(F.lit(1)).alias("Samples")))
    for c in ("LapTime", "Sector1Time", "Sector2Time", "Sector3Time"):
        if c in attrs:
            out = out.withColumn(f"{c}_seconds", parse_duration_seconds(c))
    return out


def best_laps(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """Fastest valid lap per driver and session with the gap to the session best.

    FLT-1 (lap time parses) -> AG-1 (first per lap) -> AG-2 (arg-min, ties to the
    lowest LapNumber) -> AG-3 (gap to the session minimum).
    Columns: keys, Driver, LapNumber, LapTime_seconds, Compound, Gap.
    """
    numeric = "LapTime_seconds" in df.columns or _is_numeric(df, "LapTime")
    if numeric:
        work = with_laptime_seconds(df).filter(F.col("LapTime_seconds").isNotNull())
    else:  # one regex match per sample; the text is parsed once per lap below
        work = df.filter(parsable_duration("LapTime"))
    work = drop_null_keys(work, [S.DRIVER_COL, S.LAP_COL])
    order = sample_order(work)
    has_cmp = "Compound" in work.columns
    per_lap = work.groupBy(*keys, S.DRIVER_COL, S.LAP_COL).agg(
        (first_non_null("LapTime_seconds", order) if numeric
         else F.min_by("LapTime", order)).alias("LapTime_seconds"),
        (first_non_null("Compound", order) if has_cmp else F.lit(None).cast("string")).alias("Compound"),
    )
    if not numeric:
        per_lap = per_lap.withColumn("LapTime_seconds", parse_duration_seconds("LapTime_seconds"))
    best = (per_lap.groupBy(*keys, S.DRIVER_COL)
            .agg(F.min_by(F.struct(S.LAP_COL, "LapTime_seconds", "Compound"),
                          F.struct("LapTime_seconds", S.LAP_COL)).alias("b"))
            .select(*keys, S.DRIVER_COL, "b.*"))
    # session best: a partial minimum over the per-driver table, joined back
    return (with_group_stats(best, list(keys), [F.min("LapTime_seconds").alias("_pole")])
            .withColumn("Gap", F.col("LapTime_seconds") - F.col("_pole")).drop("_pole"))


def classification(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """CH-1 / WN-7: best laps with Pos 1..n per session (order LapTime, Driver)."""
    bl = best_laps(df, keys=keys)
    return rank_by_bucket(bl, list(keys), F.floor("LapTime_seconds"), [F.col("LapTime_seconds").asc(), F.col(S.DRIVER_COL).asc()], "Pos")


def fastest_laps(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """Each driver's fastest lap (parsed LapTime, ties to the lowest LapNumber)
    from a per-lap aggregate, with the lap's sample count and X/Y counts."""
    work = with_laptime_seconds(df).filter(F.col("LapTime_seconds").isNotNull())
    xy = [F.count(c).alias(f"_n{c}") if c in work.columns else F.lit(0).alias(f"_n{c}") for c in ("X", "Y")]
    per_lap = work.groupBy(*keys, S.DRIVER_COL, S.LAP_COL).agg(
        F.min("LapTime_seconds").alias("LapTime_seconds"), F.count(F.lit(1)).alias("Samples"), *xy)
    return (per_lap.groupBy(*keys, S.DRIVER_COL)
            .agg(F.min_by(F.struct(S.LAP_COL, "LapTime_seconds", "Samples", "_nX", "_nY"),
                          F.struct("LapTime_seconds", S.LAP_COL)).alias("_f"))
            .select(*keys, S.DRIVER_COL, F.col("_f.*")))


def track_map_samples(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """CH-3 + FLT-10: fastest-lap samples of drivers whose fastest lap has some
    X and some Y values (checked on the lap table, not on the samples)."""
    fl = fastest_laps(df, keys=keys).filter((F.col("_nX") > 0) & (F.col("_nY") > 0))
    valid = with_laptime_seconds(df).filter(F.col("LapTime_seconds").isNotNull())
    return valid.join(fl.select(*keys, S.DRIVER_COL, S.LAP_COL), keys + [S.DRIVER_COL, S.LAP_COL], "left_semi")


def fastest_lap_samples(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                        drivers: list[str] | None = None) -> DataFrame:
    """JN-11: all samples of each driver's fastest lap (fastest by parsed LapTime,
    ties to the lowest LapNumber), for every driver and session at once."""
    work = df if drivers is None else df.filter(F.col(S.DRIVER_COL).isin(drivers))
    work = with_laptime_seconds(work)
    fastest = (work.filter(F.col("LapTime_seconds").isNotNull())
               .groupBy(*keys, S.DRIVER_COL)
               .agg(F.min_by(F.col(S.LAP_COL), F.struct("LapTime_seconds", S.LAP_COL)).alias(S.LAP_COL)))
    # Samples of that lap with a parsed lap time (as the analysed project keeps).
    valid = work.filter(F.col("LapTime_seconds").isNotNull())
    return valid.join(fastest, keys + [S.DRIVER_COL, S.LAP_COL], "left_semi")
