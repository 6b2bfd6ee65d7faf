"""Season jobs (PL-6, PL-7, PL-8) composed from the operators.

Each job is one lazy plan per output; actions happen only at the writes and in
the clustering fit (driver-side k choice over a one-row-per-driver matrix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import charts, clustering, features
from trackside.operators.kinematics import process_telemetry
from trackside.operators.align import semi_filter
from trackside.operators.sessions import (
    RESULT_COLUMNS,
    SESSION_LAP_COLUMNS,
    completed_rounds,
    of_rounds,
    session_predicate,
    union_by_name,
)
from trackside.operators.summaries import dedupe_first
from trackside.plans.ingest import api_ingest, session_rounds
from trackside.sources import api_docs, files, sinks, store
from trackside.session import cut_lineage


def season_clustering_job(spark: SparkSession, telemetry: DataFrame, out_dir: str, *,
                          n_clusters: int | None = None, min_rounds: int = 1,
                          min_drivers: int = S.MIN_CLUSTER_DRIVERS,
                          **feature_kw) -> dict:
    """PL-6: features of every driver's fastest lap in every session -> per-round
    z-scores -> driver matrix -> clustering -> five tables, summary and model.

    ``telemetry`` is the processed store (Acceleration present), so the feature
    pass is a single per-lap scan."""
    per_round = cut_lineage(features.round_driver_features(telemetry, **feature_kw))
    n_rounds = per_round.select(*S.SESSION_KEYS).distinct().count()
    if n_rounds < min_rounds:
        raise ValueError(f"need at least {min_rounds} round(s) with features, got {n_rounds}")
    matrix = cut_lineage(features.driver_feature_matrix(per_round))
    n_drivers = matrix.count()
    if n_drivers < min_drivers:
        raise ValueError(f"need at least {min_drivers} drivers, got {n_drivers}")
    res = clustering.fit_driver_clusters(matrix, n_clusters=n_clusters, min_rows=min_drivers)
    summary = {"n_rounds": int(n_rounds), "n_drivers": int(n_drivers), "n_clusters": int(res.n_clusters),
               "silhouette_score": round(float(res.silhouette), 4)}
    tables = {"round_features": per_round, "feature_matrix": res.feature_matrix, "labels": res.labels,
              "pca": res.pca_coords, "profiles": res.cluster_profiles}
    store.publish_run(spark, out_dir, tables, summary, save=lambda folder: clustering.save_clustering_model(res, f"{folder}/model"))
    return summary


def season_ingest_job(spark: SparkSession, raw: DataFrame, target: str, *,
                      corners: dict | None = None, preview_path: str | None = None) -> DataFrame:
    """PL-7: process only the sessions that are not committed (SNK-8), commit them to the store
    (``sources.store``), write a preview of each (SNK-2), and return the status (SNK-9)."""
    keys = sinks.STORE_PARTITIONS
    expected = raw.select(*keys).distinct()
    todo = cut_lineage(store.missing_sessions(spark, expected, target))
    if not todo.isEmpty():
        fresh = raw.join(F.broadcast(todo), [raw[k].eqNullSafe(todo[k]) for k in keys], "left_semi")
        _commit(spark, process_telemetry(fresh, corners=corners), target, preview_path)
    return store.ingest_status(spark, expected, target)


def _commit(spark: SparkSession, telemetry: DataFrame, target: str, preview_path: str | None) -> None:
    version = store.commit_sessions(telemetry, target)
    if preview_path is not None:
        live = store.live_sessions(spark, target).filter(F.col("version") == version)
        written = store.read_store(spark, target)
        new = written.join(F.broadcast(live), [written[k].eqNullSafe(live[k]) for k in sinks.STORE_PARTITIONS], "left_semi")
        sinks.write_previews(new, preview_path)


def season_api_job(spark: SparkSession, *, schedule: DataFrame, target: str, as_of: str, docs: dict[str, DataFrame],
                   session_filter: Column | None = None, preview_path: str | None = None,
                   corners: dict | None = None, rejects_path: str | None = None, **ingest_kw) -> DataFrame:
    """PL-7 end to end: completed rounds (FLT-4) -> sessions of these rounds (JN-5) that the
    store lacks (SNK-8) -> telemetry and rejects (PL-2) -> corners and acceleration (PL-1) -> store ->
    previews of the new sessions (SNK-2). Returns the status (SNK-9); a second run writes nothing.

    ``docs`` holds the landed documents: sessions, drivers, laps, stints, car_data, location."""
    done = completed_rounds(schedule.withColumn("EventDate", F.to_date("EventDate")), as_of=as_of)
    sessions = docs["sessions"] if session_filter is None else docs["sessions"].filter(session_filter)
    rounds, _ = session_rounds(sessions, done)
    rounds = cut_lineage(rounds)
    expected = rounds.select(*sinks.STORE_PARTITIONS).distinct()
    todo = store.missing_sessions(spark, expected, target)
    fresh = sessions.join(rounds.join(todo, sinks.STORE_PARTITIONS, "left_semi").select("session_key"),
                          "session_key", "left_semi")
    if not fresh.isEmpty():
        tel, rejects = api_ingest(sessions=fresh, schedule=done, **{k: v for k, v in docs.items() if k != "sessions"}, **ingest_kw)
        _commit(spark, process_telemetry(tel, corners=corners), target, preview_path)
        if rejects_path is not None:
            rejects.filter("reason <> 'session_filtered'").write.mode("append").parquet(rejects_path)
    return store.ingest_status(spark, expected, target)


JOB_ENDPOINTS = ("sessions", "drivers", "laps", "stints", "car_data", "location")


def season_landed_job(spark: SparkSession, root: str, schedule_path: str, *, target: str, as_of: str,
                      rejects_path: str | None = None, **kw) -> DataFrame:
    """PL-7 from files: the landed documents of every endpoint (SRC-4) and the schedule file (SRC-3)
    into ``season_api_job``. Documents that do not parse go to ``<rejects_path>/documents``."""
    docs, broken = {}, None
    for endpoint in JOB_ENDPOINTS:
        docs[endpoint], bad = api_docs.read_documents(spark, root, endpoint)
        broken = bad if broken is None else broken.unionByName(bad)
    if rejects_path is not None:
        broken.write.mode("overwrite").parquet(f"{rejects_path}/documents")
        kw["rejects_path"] = f"{rejects_path}/samples"
    return season_api_job(spark, schedule=files.read_schedule(spark, schedule_path), target=target, as_of=as_of, docs=docs, **kw)


def season_results(results: DataFrame, schedule: DataFrame) -> DataFrame:
    """ST-3 / PL-8: the race results of all (completed) rounds in one table."""
    return of_rounds(results, schedule, RESULT_COLUMNS)


def api_summaries(docs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """PL-8, second source: the season's summary tables from landed documents. Standings and
    overtakes of races only, grids of qualifying and races, one row per driver; the other
    tables as they are. All sessions, without the request limits of a client."""
    sessions = docs["sessions"]
    races = sessions.filter(session_predicate(name_contains="Race")).select("session_key")
    graded = sessions.filter(session_predicate(types=["Qualifying", "Race"])).select("session_key")
    out = {}
    for name, df in docs.items():
        if name in ("championship_drivers", "championship_teams", "overtakes"):
            df = semi_filter(df, races, "session_key")
        elif name == "starting_grid":
            df = semi_filter(df, graded, "session_key")
        elif name == "drivers":
            df = dedupe_first(df, ["driver_number"], ["session_key"])
        out[name] = df
    return out


def season_summaries(schedule: DataFrame, lap_tables: dict[str, DataFrame], *, as_of: str) -> dict[str, DataFrame]:
    """PL-8: completed schedule rounds and the union of per-session-type lap
    tables (columns differ by session type) with ``*_seconds`` columns."""
    from trackside.functions.durations import parse_duration_seconds
    sched = completed_rounds(schedule.withColumn("EventDate", F.to_date("EventDate")), as_of=as_of)
    named = "EventName" in sched.columns
    parts = [of_rounds(df, sched, SESSION_LAP_COLUMNS.get(st, df.columns), session_type=st)
             if named and "Round" in df.columns else df.withColumn("SessionType", F.lit(st)) for st, df in lap_tables.items()]
    laps = union_by_name(parts)
    for c in ("LapTime", "Sector1Time", "Sector2Time", "Sector3Time"):
        if c in laps.columns:
            laps = laps.withColumn(f"{c}_seconds", parse_duration_seconds(c))
    return {"schedule": sched, "laps": laps}


def cluster_charts(res: clustering.ClusteringResult) -> dict[str, DataFrame]:
    """CH-6..8 tables of a clustering result."""
    return {"scatter": charts.pca_scatter(res.labels, res.pca_coords),
            "radar": charts.radar_long(res.cluster_profiles),
            "roster": charts.cluster_roster(res.labels)}
