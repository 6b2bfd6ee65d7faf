"""Session/schedule predicates and unions (FLT-4, FLT-5, FLT-6, ST-1..4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_rounds(schedule: DataFrame, *, as_of: str, round_col: str = "RoundNumber",
                     date_col: str = "EventDate") -> DataFrame:
    """FLT-4/5: rounds > 0 (round 0 is testing) with an event date on or before
    ``as_of`` (an explicit date keeps runs deterministic), sorted."""
    return (schedule.filter((F.col(round_col) > 0) & F.col(date_col).isNotNull()
                            & (F.col(date_col) <= F.to_date(F.lit(as_of))))
            .orderBy(round_col, date_col))


def session_predicate(name_col: str = "session_name", type_col: str = "session_type", *,
                      name_contains: str | None = None, types: list[str] | None = None,
                      name_equals: str | None = None):
    """FLT-6: session filters (name contains / type in / name equals)."""
    cond = F.lit(True)
    if name_contains is not None:
        cond = cond & F.col(name_col).contains(name_contains)
    if types is not None:
        cond = cond & F.col(type_col).isin(*types)
    if name_equals is not None:
        cond = cond & (F.col(name_col) == name_equals)
    return cond


# Columns of the season tables (fixed values).
LAP_BASE = ["DriverNumber", "Driver", "LapNumber", "LapTime", "Sector1Time", "Sector2Time", "Sector3Time"]
SESSION_LAP_COLUMNS = {"Race": [*LAP_BASE, "Compound", "FreshTyre"], "Qualifying": [*LAP_BASE, "IsPersonalBest"],
                       "FP3": [*LAP_BASE, "Compound"]}
RESULT_COLUMNS = ["DriverNumber", "Driver", "Abbreviation", "Team", "ClassifiedFinishingPosition", "Points"]


def of_rounds(df: DataFrame, schedule: DataFrame, columns: list[str], *, session_type: str | None = None) -> DataFrame:
    """PRJ-3: the given columns of all rounds at once with Round and EventName (and
    SessionType); rows of rounds that are not in ``schedule`` go."""
    events = schedule.select(F.col("RoundNumber").cast("int").alias("Round"), "EventName")
    tail = [] if session_type is None else [F.lit(session_type).alias("SessionType")]
    return (df.withColumn("Round", F.col("Round").cast("int")).join(events, "Round")
            .select(*[c for c in columns if c in df.columns], "Round", "EventName", *tail))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """ST-1..4: union of frames whose columns differ; missing columns are nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
