"""PL-2: landed API documents -> canonical telemetry for every session at once.

sessions -> round (JN-5) ; car_data <- nearest location within 200 ms (JN-1) ;
samples -> laps by time interval (JN-2, WN-5) ; lap attributes (JN-4) minus
pit-out laps (FLT-7) ; compound from stints (JN-3) ; TimeInLap (WN-3) ;
canonical columns (PRJ-4, PRJ-1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.durations import seconds_to_duration_text
from trackside.operators import align
from trackside.operators.summaries import dedupe_first
from trackside.session import cut_lineage
from trackside.sources.files import canonical_order


# Session names of the API and the store's session types (fixed values).
SESSION_TYPES = {"Qualifying": "Q", "Race": "R", "Sprint": "S", "Sprint Qualifying": "SQ", "Sprint Shootout": "SQ",
                 "Practice 1": "FP1", "Practice 2": "FP2", "Practice 3": "FP3"}


def session_type(name: str = "session_name") -> Column:
    """PRJ-2: the store's SessionType of a session name; unknown names stay as they are."""
    known = F.create_map(*[F.lit(x) for kv in SESSION_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.col(name)), F.col(name))


def session_rounds(sessions: DataFrame, schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-5 for every season: (session_key, Year, Round, SessionType) and the sessions
    without a round. The year takes part wherever the schedule tells it (``Year`` or
    ``EventDate``)."""
    own = sessions.select("session_key", "country_name", "location", "year", session_type().alias("SessionType"))
    keys, on = ["Country", "Location"], ["country_name", "location"]
    sched = schedule.filter(F.col("RoundNumber") > 0)
    if "Year" in schedule.columns or "EventDate" in schedule.columns:
        year = F.col("Year") if "Year" in schedule.columns else F.year(F.to_date("EventDate"))
        sched = sched.withColumn("_year", year.cast("int"))
        keys, on = keys + ["_year"], on + ["year"]
    found, missing = align.map_rounds(own, sched.select(*keys, "RoundNumber"), session_key=on, schedule_key=keys)
    return found.select("session_key", F.col("year").alias("Year"), F.col("RoundNumber").cast("int").alias("Round"),
                        "SessionType"), missing


BY = ["session_key", "driver_number"]


def align_samples(*, rounds: DataFrame, laps: DataFrame, car_data: DataFrame, location: DataFrame | None = None,
                  tolerance_seconds: float = S.ASOF_TOLERANCE_SECONDS, lap_bucket_seconds: float = 120.0) -> DataFrame:
    """Every car sample of the sessions in ``rounds``, once: position (with ``location``), lap, lap
    attributes, and ``reason`` why it is not stored (``sample_no_lap``, ``sample_pit_out``) or null."""
    car = car_data.join(rounds.select("session_key"), "session_key", "left_semi")
    if location is not None:
        loc = location.select(*BY, F.col("date").alias("loc_date"), "x", "y", "z")
        car = align.asof_nearest(car, loc, by=BY, left_ts="date", right_ts="loc_date",
                                 tolerance_seconds=tolerance_seconds, right_cols=["x", "y", "z"])
    tagged = align.assign_laps(car, laps.select(*BY, "lap_number", "date_start", "lap_duration"), by=BY, sample_ts="date",
                               bucket_seconds=lap_bucket_seconds, out_col="lap_number", keep_unassigned=True)
    meta = laps.select(*BY, "lap_number", "lap_duration", "duration_sector_1", "duration_sector_2",
                       "duration_sector_3", "is_pit_out_lap")
    pit_out = F.coalesce(F.col("is_pit_out_lap").cast("boolean"), F.lit(False))
    return tagged.join(meta, [*BY, "lap_number"], "left").withColumn(
        "reason", F.when(F.col("lap_number").isNull(), F.lit("sample_no_lap")).when(pit_out, F.lit("sample_pit_out")))


def api_ingest(*, sessions: DataFrame, drivers: DataFrame, laps: DataFrame, stints: DataFrame, car_data: DataFrame,
               location: DataFrame, schedule: DataFrame, session_filter: Column | None = None,
               tolerance_seconds: float = S.ASOF_TOLERANCE_SECONDS,
               lap_bucket_seconds: float = 120.0) -> tuple[DataFrame, DataFrame]:
    """PL-2: (canonical telemetry, rejects) from one alignment of the samples, which is written as a
    stage and read by both. ``session_filter`` (FLT-6, see ``operators.sessions.session_predicate``)
    picks the sessions; default all."""
    picked = sessions if session_filter is None else sessions.filter(session_filter)
    rounds, missing = session_rounds(picked, schedule)
    aligned = cut_lineage(align_samples(rounds=rounds, laps=laps, car_data=car_data, location=location,
                                        tolerance_seconds=tolerance_seconds, lap_bucket_seconds=lap_bucket_seconds))
    telemetry = _canonical(aligned.filter(F.col("reason").isNull()), rounds, drivers, laps, stints)
    return telemetry, _rejects(aligned, car_data, picked, missing)


def api_to_telemetry(**documents) -> DataFrame:
    """PL-2: the telemetry of ``api_ingest``."""
    return api_ingest(**documents)[0]


def _rejects(aligned: DataFrame, car_data: DataFrame, picked: DataFrame, missing: DataFrame) -> DataFrame:
    """Counts by session: whole sessions from the sample table's session column, samples from the alignment."""
    per_session = car_data.groupBy("session_key").agg(F.count(F.lit(1)).alias("count"))
    gone = per_session.join(picked.select("session_key"), "session_key", "left_anti").withColumn("reason", F.lit("session_filtered"))
    lost = per_session.join(missing.select("session_key"), "session_key", "left_semi").withColumn("reason", F.lit("session_unmatched"))
    samples = (aligned.filter(F.col("reason").isNotNull()).groupBy("session_key", "reason")
               .agg(F.count(F.lit(1)).alias("count")))
    cols = ["session_key", "reason", "count"]
    return gone.select(*cols).unionByName(lost.select(*cols)).unionByName(samples.select(*cols))


def _canonical(tagged: DataFrame, rounds: DataFrame, drivers: DataFrame, laps: DataFrame, stints: DataFrame) -> DataFrame:
    lap_keys = [*BY, "lap_number"]
    tyres = align.stint_compounds(laps.select(*lap_keys).distinct(),
                                  stints.select(*BY, F.col("stint_number").alias("stint_order"),
                                                "lap_start", "lap_end", "compound"),
                                  by=BY, lap_col="lap_number")
    timed = align.time_in_lap(tagged, lap_keys=lap_keys, ts="date", stage=False)
    names = dedupe_first(drivers.select(*BY, "name_acronym"), BY, ["name_acronym"])
    j = (timed.join(tyres, lap_keys, "left")
         .join(rounds, "session_key", "inner")
         .join(names, BY, "left"))
    out = j.select(
        F.col("Year").cast("int").alias("Year"), "Round", "SessionType",
        F.col("driver_number").cast("string").alias("DriverNumber"), F.col("name_acronym").alias("Driver"),
        F.col("lap_number").cast("int").alias("LapNumber"), "TimeInLap",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX").alias("Time"),
        F.col("throttle").cast("double").alias("Throttle"),
        F.when(F.col("brake").isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.col("brake") != 0).alias("Brake"),
        F.col("drs").cast("int").alias("DRS"), F.col("rpm").cast("double").alias("RPM"),
        F.col("speed").cast("double").alias("Speed"),
        F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"),
        F.lit(None).cast("double").alias("Steering"), F.col("n_gear").cast("int").alias("Gear"),
        seconds_to_duration_text("lap_duration").alias("LapTime"),
        seconds_to_duration_text("duration_sector_1", zero_is_missing=False).alias("Sector1Time"),
        seconds_to_duration_text("duration_sector_2", zero_is_missing=False).alias("Sector2Time"),
        seconds_to_duration_text("duration_sector_3", zero_is_missing=False).alias("Sector3Time"),
        "Compound", "FreshTyre")
    return canonical_order(out)


def landed_laps_to_telemetry(samples: DataFrame, laps: DataFrame, *, ts: str = "Time") -> tuple[DataFrame, DataFrame]:
    """SRC-5: landed samples (with session, DriverNumber, LapNumber, ``ts``) and landed laps ->
    (canonical telemetry, rejects).

    Lap attributes are attached by an equi-join (JN-4), TimeInLap counts from the lap's first
    sample (WN-3). Rejects count the samples per session without a lap (``no_lap``) or
    without a time (``no_time``)."""
    keys = [*S.SESSION_KEYS, "DriverNumber", S.LAP_COL]
    timed = samples.filter(F.col(ts).isNotNull())
    attrs = dedupe_first(laps, keys, [c for c in laps.columns if c not in keys])
    tel = align.time_in_lap(align.attach_lap_attributes(timed, attrs, keys=keys), lap_keys=keys, ts=ts)
    bad = (samples.filter(F.col(ts).isNull()).withColumn("reason", F.lit("no_time"))
           .unionByName(timed.join(attrs.select(*keys), keys, "left_anti").withColumn("reason", F.lit("no_lap"))))
    return canonical_order(tel), bad.groupBy(*S.SESSION_KEYS, "reason").agg(F.count(F.lit(1)).alias("count"))


def api_ingest_rejects(*, sessions: DataFrame, laps: DataFrame, car_data: DataFrame, schedule: DataFrame,
                       session_filter: Column | None = None, lap_bucket_seconds: float = 120.0) -> DataFrame:
    """What PL-2 leaves out, counted per session: (session_key, reason, count) in samples.

    Reasons: ``session_filtered`` (not picked, or not in the session table),
    ``session_unmatched`` (no round), ``sample_no_lap`` and ``sample_pit_out``. Per session,
    samples in = stored + rejects. Samples are aligned once, without their positions;
    ``api_ingest`` gives the same counts along with the telemetry."""
    picked = sessions if session_filter is None else sessions.filter(session_filter)
    rounds, missing = session_rounds(picked, schedule)
    aligned = align_samples(rounds=rounds, laps=laps, car_data=car_data.select(*BY, "date"),
                            lap_bucket_seconds=lap_bucket_seconds)
    return _rejects(aligned, car_data, picked, missing)
