"""Alignment of samples, laps, stints and sessions (JN-1..5, JN-9, WN-3, WN-5, FLT-7).

None of these operators runs a window over a whole driver or session, or
emits all pairs of a group: the as-of join works inside (key, time bucket)
partitions that also hold the neighbouring buckets' right rows; the interval
join replicates each lap into the time buckets it covers; stints are expanded
into their lap numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S
from trackside.operators.intervals import stab
from trackside.session import cut_lineage


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch for timestamp, timestamp_ntz or numeric-seconds columns."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(col))
    return F.floor(F.col(col).cast("double") * 1000000.0 + 0.5).cast("long")


def asof_nearest(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str,
                 tolerance_seconds: float = S.ASOF_TOLERANCE_SECONDS, right_cols: list[str],
                 right_order: str | None = None, prefix: str = "", bucket_factor: int = 4) -> DataFrame:
    """JN-1: left as-of join to the nearest right row of the same ``by`` key.

    |dt| <= tolerance (inclusive); equal distance -> the earlier (backward) row;
    duplicate right timestamps -> the last one backward, the first one forward
    (right order = timestamp, then ``right_order``). Unmatched left rows keep
    null right columns.

    Plan: rows are bucketed by ``floor(t / W)`` with W = ``bucket_factor`` x
    tolerance; a right row within one tolerance of its bucket's lower (upper)
    edge is also copied into the previous (next) bucket, so one exchange by
    (key, bucket) brings together every right row that can lie within tolerance
    of the bucket's left rows (right side shuffled 1 + 2/factor times). The
    nearest backward right row is a running ``last`` (ignoring nulls) in time
    order, the nearest forward one a running ``last`` in reversed order: each row
    is visited twice, there is no join and there are no pairs, and a hot key is
    split by time.
    """
    tol_us = int(round(tolerance_seconds * 1000000))
    if tol_us <= 0 or bucket_factor < 1:
        raise ValueError("tolerance and bucket_factor must be positive")
    width = tol_us * int(bucket_factor)
    rord = F.col(right_order) if right_order else F.lit(0)
    lcols = left.columns
    rtype = T.StructType([T.StructField("_rt", T.LongType()), T.StructField("_ro", T.LongType())]
                         + [right.schema[c] for c in right_cols])
    lt = micros(left, left_ts)
    Lx = left.select(*[F.col(k) for k in by], lt.alias("_t"), F.floor(lt / F.lit(width)).cast("long").alias("_b"),
                     F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_ro"),
                     F.struct(*[F.col(c) for c in lcols]).alias("_l"), F.lit(None).cast(rtype).alias("_r"))
    rt = micros(right, right_ts)
    rb = F.floor(rt / F.lit(width)).cast("long")
    # own bucket, plus the previous / next bucket when within tolerance of that edge
    copies = F.filter(F.array(
        F.when(rt - rb * width <= tol_us, rb - 1), rb,
        F.when((rb + 1) * width - rt <= tol_us, rb + 1)), lambda b: b.isNotNull())
    Rx = right.select(*[F.col(k) for k in by], rt.alias("_t"),
                      F.explode(copies).alias("_b"),
                      F.lit(0).alias("_side"), rord.cast("long").alias("_ro"),
                      F.lit(None).cast(Lx.schema["_l"].dataType).alias("_l"),
                      F.struct(rt.alias("_rt"), rord.cast("long").alias("_ro"),
                               *[F.col(c) for c in right_cols]).alias("_r"))
    order = ["_t", "_side", "_ro"]
    w = Window.partitionBy(*by, "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = (Lx.unionByName(Rx)
               .withColumn("_bk", F.last("_r", ignorenulls=True).over(w.orderBy(*order)))
               .withColumn("_fw", F.last("_r", ignorenulls=True).over(w.orderBy(*[F.desc_nulls_last(c) for c in order])))
               .filter(F.col("_side") == 1))
    db = F.col("_t") - F.col("_bk._rt")
    df_ = F.col("_fw._rt") - F.col("_t")
    back_ok = F.col("_bk").isNotNull() & (db <= tol_us)
    fwd_ok = F.col("_fw").isNotNull() & (df_ <= tol_us)
    pick = (F.when(back_ok & (~fwd_ok | (db <= df_)), F.col("_bk"))
            .when(fwd_ok, F.col("_fw")))
    out = scanned.withColumn("_m", pick)
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                      *[F.col(f"_m.{c}").alias(prefix + c) for c in right_cols])


def lap_windows(laps: DataFrame, *, by: list[str], lap_col: str = "lap_number", start: str = "date_start",
                duration: str = "lap_duration",
                fallback_seconds: float = S.LAP_END_FALLBACK_SECONDS) -> DataFrame:
    """WN-5: ``_start_us``/``_end_us`` per lap: start + duration when duration > 0,
    else the next lap's start, else start + fallback; ``end_source`` says which.
    The window is over one driver's laps (a lap table, tens of rows per driver)."""
    s_us = micros(laps, start)
    out = laps.withColumn("_start_us", s_us)
    w = Window.partitionBy(*by).orderBy(F.col("_start_us"), F.col(lap_col))
    nxt = F.lead("_start_us").over(w)
    dur = F.col(duration).cast("double")
    has_dur = dur.isNotNull() & (dur > 0)
    out = out.withColumn("_next_us", nxt)
    end = (F.when(has_dur, F.col("_start_us") + F.floor(dur * 1000000.0 + 0.5).cast("long"))
           .when(F.col("_next_us").isNotNull(), F.col("_next_us"))
           .otherwise(F.col("_start_us") + int(round(fallback_seconds * 1000000))))
    src = (F.when(has_dur, F.lit("duration")).when(F.col("_next_us").isNotNull(), F.lit("next_start"))
           .otherwise(F.lit("fallback")))
    return out.withColumn("_end_us", end).withColumn("end_source", src).drop("_next_us")


def assign_laps(samples: DataFrame, laps: DataFrame, *, by: list[str], sample_ts: str,
                lap_col: str = "lap_number", start: str = "date_start", duration: str = "lap_duration",
                bucket_seconds: float = 3600.0, out_col: str = S.LAP_COL, keep_unassigned: bool = False,
                fallback_seconds: float = S.LAP_END_FALLBACK_SECONDS) -> DataFrame:
    """JN-2: tag each sample with the lap whose [start, end] (both inclusive) holds
    it; on overlap the later-starting lap wins; samples in no lap are dropped, or with
    ``keep_unassigned`` stay with a null lap. Repeated samples stay repeated.

    Laps are looked up by the ``bucket_seconds`` time buckets that hold samples, through the
    dyadic index of ``operators.intervals``: a lap costs at most two index rows a level,
    however long it is, and meets only buckets with samples of its key. A bucket's laps
    (those of one driver in that time) are joined to its samples as one list, latest
    start first, so every sample is one row before and after the join.
    """
    bw = int(round(bucket_seconds * 1000000))
    lw = lap_windows(laps, by=by, lap_col=lap_col, start=start, duration=duration,
                     fallback_seconds=fallback_seconds)
    bucket = lambda c: F.floor(c / F.lit(bw)).cast("long")
    lx = lw.select(*by, F.struct(F.col("_start_us").alias("s"), F.col(lap_col).alias("lap"), F.col("_end_us").alias("e")).alias("_l"),
                   bucket(F.col("_start_us")).alias("_b0"), bucket(F.col("_end_us")).alias("_b1"))
    sx = samples.withColumn("_t", micros(samples, sample_ts)).withColumn("_b", bucket(F.col("_t")))
    filled = samples.select(*by, bucket(micros(samples, sample_ts)).alias("_b")).distinct()
    here = (stab(filled, lx, by=by, point="_b", low="_b0", high="_b1").groupBy(*by, "_b")
            .agg(F.sort_array(F.collect_set("_l"), asc=False).alias("_ls")))
    holds = F.filter("_ls", lambda x: (x["s"] <= F.col("_t")) & (F.col("_t") <= x["e"]))
    out = sx.join(here, [*by, "_b"], "left" if keep_unassigned else "inner").withColumn(
        out_col, F.try_element_at(holds, F.lit(1))["lap"])
    rest = [c for c in samples.columns if c not in by and c != out_col]
    out = out.select(*by, *rest, out_col)
    return out if keep_unassigned else out.filter(F.col(out_col).isNotNull())


def stint_compounds(laps: DataFrame, stints: DataFrame, *, by: list[str], lap_col: str = S.LAP_COL,
                    stint_order: str = "stint_order") -> DataFrame:
    """JN-3: Compound of the first stint (lowest ``stint_order``) with
    lap_start <= lap <= lap_end (missing lap_end = lap_start); FreshTyre is true
    when a stint matched, else null (as in the analysed project).

    Stints are looked up by the lap numbers that occur, through the dyadic index of
    ``operators.intervals``: a stint costs at most two index rows a level, whatever its end."""
    end = F.coalesce(F.col("lap_end"), F.col("lap_start"))
    sx = stints.select(*by, F.col(stint_order).alias("_so"), "compound",
                       F.col("lap_start").cast("long").alias("_lo"), end.cast("long").alias("_hi"))
    numbers = laps.select(*by, F.col(lap_col)).distinct()
    first = (stab(numbers, sx, by=by, point=lap_col, low="_lo", high="_hi").groupBy(*by, lap_col)
             .agg(F.min_by("compound", "_so").alias("Compound"))
             .withColumn("FreshTyre", F.lit(True)))
    return laps.join(first, [*by, lap_col], "left")


def attach_lap_attributes(samples: DataFrame, lap_attrs: DataFrame, *, keys: list[str]) -> DataFrame:
    """JN-4: inner equi-join of samples to lap attributes; laps without attributes drop."""
    return samples.join(lap_attrs, keys, "inner")


def time_in_lap(samples: DataFrame, *, lap_keys: list[str], ts: str, out_col: str = S.TIME_COL,
                stage: bool = True) -> DataFrame:
    """WN-3: seconds since the first sample of the lap. The lap start is a partial
    aggregate joined back on the lap keys (no whole-lap window). With ``stage`` the samples are
    written once as Parquet first, so that the work before is not done twice; pass False
    where they are read from a table anyway."""
    samples = cut_lineage(samples) if stage else samples
    t = micros(samples, ts)
    first = samples.groupBy(*lap_keys).agg(F.min(t).alias("_lap_t0"))
    return (samples.join(first, lap_keys, "inner")
            .withColumn(out_col, (t - F.col("_lap_t0")) / F.lit(1000000.0)).drop("_lap_t0"))


def drop_pit_out_laps(df: DataFrame, flag: str = "is_pit_out_lap") -> DataFrame:
    """FLT-7: drop pit-out laps; a null flag counts as not pit-out (deliberate,
    documented deviation from the analysed project's NaN truthiness)."""
    return df.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def dedupe_last(schedule: DataFrame, key: list[str], order: str) -> DataFrame:
    """T11: duplicate keys keep the row with the greatest ``order`` (last wins)."""
    rest = [c for c in schedule.columns if c not in key]
    return (schedule.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def map_rounds(sessions: DataFrame, schedule: DataFrame, *, session_key: list[str],
               schedule_key: list[str], round_col: str = "RoundNumber") -> tuple[DataFrame, DataFrame]:
    """JN-5: sessions -> round on the composite key (last schedule row wins on
    duplicates); returns (matched, unmatched). The schedule is a dimension."""
    sched = dedupe_last(schedule.select(*schedule_key, round_col), schedule_key, round_col)
    cond = [sessions[a] == sched[b] for a, b in zip(session_key, schedule_key)]
    matched = sessions.join(sched, cond, "inner").select(sessions["*"], sched[round_col])
    missing = sessions.join(sched, cond, "left_anti")
    return matched, missing


def semi_filter(facts: DataFrame, dims: DataFrame, on: list[str] | str) -> DataFrame:
    """JN-9: fact rows of selected dimension rows only (left semi join)."""
    return facts.join(dims, on, "left_semi")
