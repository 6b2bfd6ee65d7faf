import gzip
import json
import os
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.plans.ingest import api_to_telemetry
from trackside.sources import api_docs, files, sinks
from trackside.sources.store import live_sessions, read_store
from trackside.streaming.ingest import start_ingest


def test_read_csv_gz_fallback_and_schedule(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "schedule.csv")
    with gzip.open(p + ".gz", "wt") as f:
        f.write("Unnamed: 0,RoundNumber,Country,Location,EventDate\n0,0,Bahrain,Sakhir,2025-02-28\n"
                "1,1,Australia,Melbourne,2025-03-16\n")
    df = files.read_schedule(spark, p)
    assert "Unnamed: 0" not in df.columns and df.count() == 2


def test_processed_discovery_priority(spark, tmpdir_fresh):
    d = tmpdir_fresh
    cols = "Driver,LapNumber,TimeInLap\n"
    for name, body in [("r01_australia_2025_quali_telemetry_processed.csv", "VER,1,0.0\nNOR,1,0.0\n"),
                       ("r01_australia_2025_quali_telemetry_processed_sample.csv", "VER,1,0.0\n"),
                       ("r02_china_2025_quali_telemetry_processed_sample.csv", "PIA,1,0.0\n")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(cols + body)
    schema = "Driver string, LapNumber int, TimeInLap double"
    got = sorted((r.Round, r.Driver, r.is_sample, r.event_slug)
                 for r in files.read_processed_sessions(spark, d, schema).collect())
    assert got == [(1, "NOR", False, "australia"), (1, "VER", False, "australia"), (2, "PIA", True, "china")]


def _raw(spark, rounds):
    rows = [(2025, r, "Q", "1", "VER", 1, float(i), float(100 + i), -900.0, -1500.0, False, i)
            for r in rounds for i in range(5)]
    return spark.createDataFrame(rows, "Year int, Round int, SessionType string, DriverNumber string, "
                                       "Driver string, LapNumber int, TimeInLap double, Speed double, "
                                       "X double, Y double, Brake boolean, sample_id long")


def test_store_incremental_and_manifest(spark, tmpdir_fresh):
    from trackside.plans.jobs import season_ingest_job
    store = os.path.join(tmpdir_fresh, "store")
    m1 = {r.Round: (r.q_ok, r.r_ok) for r in season_ingest_job(spark, _raw(spark, [1]), store).collect()}
    assert m1 == {1: (True, False)}
    before = {r.Round: r.version for r in live_sessions(spark, store).collect()}
    m2 = {r.Round: r.q_ok for r in season_ingest_job(spark, _raw(spark, [1, 2]), store).collect()}
    assert m2 == {1: True, 2: True}
    after = {r.Round: r.version for r in live_sessions(spark, store).collect()}
    assert before[1] == after[1] and before.keys() == {1} and after.keys() == {1, 2}  # round 1 was not rewritten
    stored = read_store(spark, store)
    assert stored.count() == 10 and "Acceleration" in stored.columns and "Corner" in stored.columns


def test_preview_bounded_and_ordered(spark):
    pv = sinks.preview(_raw(spark, [2, 1]), n_lines=4).collect()
    assert [(r.Round, r.TimeInLap) for r in pv] == [(1, 0.0), (1, 1.0), (1, 2.0)]


def test_streaming_ingest_only_new_files(spark, tmpdir_fresh):
    landed = os.path.join(tmpdir_fresh, "landed")
    store = os.path.join(tmpdir_fresh, "store")
    ckpt = os.path.join(tmpdir_fresh, "ckpt")
    schema = _raw(spark, [1]).schema
    _raw(spark, [1]).write.parquet(os.path.join(landed, "s1"))
    q = start_ingest(spark, landed + "/*", store, ckpt, schema=schema)
    q.awaitTermination(120)
    assert read_store(spark, store).count() == 5
    _raw(spark, [2]).write.parquet(os.path.join(landed, "s2"))
    q = start_ingest(spark, landed + "/*", store, ckpt, schema=schema)
    q.awaitTermination(120)
    assert sorted(r.Round for r in read_store(spark, store).select("Round").distinct().collect()) == [1, 2]
    assert read_store(spark, store).count() == 10


def test_processed_discovery_keeps_every_season(spark, tmpdir_fresh):
    for name, body in [("r01_australia_2024_quali_telemetry_processed.csv", "VER,1,0.0\n"),
                       ("r01_australia_2025_quali_telemetry_processed.csv", "NOR,1,0.0\n"),
                       ("r01_australia_2025_quali_telemetry_processed_sample.csv", "NOR,1,0.0\n")]:
        with open(os.path.join(tmpdir_fresh, name), "w") as f:
            f.write("Driver,LapNumber,TimeInLap\n" + body)
    got = files.read_processed_sessions(spark, tmpdir_fresh, "Driver string, LapNumber int, TimeInLap double")
    assert sorted((r.Year, r.Round, r.Driver) for r in got.collect()) == [(2024, 1, "VER"), (2025, 1, "NOR")]
    none = files.read_processed_sessions(spark, os.path.join(tmpdir_fresh, "nothing"), "Driver string")
    assert none.count() == 0 and none.columns == ["Driver", "Year", "Round", "event_slug", "is_sample"]


def test_streaming_ingest_joins_split_sessions(spark, tmpdir_fresh):
    landed, store, ckpt = (os.path.join(tmpdir_fresh, x) for x in ("landed", "store", "ckpt"))
    whole = _raw(spark, [1])
    later = whole.withColumn("TimeInLap", F.col("TimeInLap") + 5).withColumn("sample_id", F.col("sample_id") + 5)
    for n, part in enumerate((whole.filter("TimeInLap < 2"), whole.filter("TimeInLap >= 2"))):
        part.coalesce(1).write.parquet(os.path.join(landed, f"s{n}"))
    start_ingest(spark, landed + "/*", store, ckpt, schema=whole.schema, max_files_per_trigger=1).awaitTermination(120)
    assert read_store(spark, store).count() == 5
    later.write.parquet(os.path.join(landed, "s9"))  # the same session goes on in another run
    start_ingest(spark, landed + "/*", store, ckpt, schema=whole.schema).awaitTermination(120)
    got = read_store(spark, store)
    assert got.count() == 10 and got.select("TimeInLap").distinct().count() == 10


def test_streaming_reads_the_files_of_touched_sessions_only(spark, tmpdir_fresh):
    from trackside.streaming.ingest import file_index, files_of
    landed, store, ckpt = (os.path.join(tmpdir_fresh, x) for x in ("landed", "store", "ckpt"))
    schema = _raw(spark, [1]).schema
    for n, rounds in enumerate(([1], [2], [1, 3])):
        _raw(spark, rounds).coalesce(1).write.parquet(os.path.join(landed, f"s{n}"))
    start_ingest(spark, landed + "/*", store, ckpt, schema=schema, max_files_per_trigger=1).awaitTermination(120)
    assert {r.Round: r["count"] for r in read_store(spark, store).groupBy("Round").count().collect()} == {1: 10, 2: 5, 3: 5}
    index = file_index(spark, ckpt)
    for rounds, folders in (([2], {"s1"}), ([3], {"s2"}), ([1], {"s0", "s2"})):
        touched = _raw(spark, rounds).select("Year", "Round", "SessionType").distinct()
        assert {r.file.rsplit("/", 2)[1] for r in files_of(index, touched).collect()} == folders
    # round 2 was computed by one batch only, round 1 by two
    versions = {r.version: r.Round for r in live_sessions(spark, store).collect()}
    assert len(versions) >= 2 and sorted(r["count"] for r in index.groupBy("batch").count().collect()) == [1, 1, 2]


def test_documents_are_landed_as_lines_and_broken_ones_kept_apart(spark, tmpdir_fresh):
    source, root = os.path.join(tmpdir_fresh, "dump"), os.path.join(tmpdir_fresh, "landed")
    os.makedirs(source)
    good = [{"session_key": 1, "driver_number": n, "date": "2025-03-15T05:00:00.5+00:00", "x": n, "y": 1.5} for n in range(5)]
    odd = [{"session_key": 1, "driver_number": "seven", "date": "2025-03-15T05:00:00+00:00"}, {"session_key": 1, "date": "yesterday"}]
    for name, text in (("a.json", json.dumps(good, indent=2)), ("b.json", json.dumps(good[0])), ("c.json", json.dumps(good)[:-9]),
                       ("d.json", json.dumps(odd + good[:1])), ("e.json", "[1, \"x\", {\"session_key\": 2}]"), ("f.json", " "), ("g.json", "[]"),
                       ("h.json", "no json")):
        with open(os.path.join(source, name), "w") as f:
            f.write(text)
    landed = api_docs.land_documents(spark, source, root, "location")
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in landed.collect()) == [
        ("c.json", "document"), ("e.json", "not_an_object"), ("e.json", "not_an_object"), ("h.json", "not_an_object")]
    rows, rejects = api_docs.read_documents(spark, root, "location")
    assert rows.schema == api_docs.ENDPOINT_SCHEMAS["location"]
    got = sorted((r.session_key, r.driver_number, r.x) for r in rows.filter("driver_number IS NOT NULL").collect())
    assert got == sorted([(1, n, float(n)) for n in range(5)] + [(1, 0, 0.0)] * 2)
    assert rows.filter("session_key = 2").count() == 1 and rows.count() == 8
    assert sorted(json.loads(r.document)["session_key"] for r in rejects.collect()) == [1, 1]
    none = api_docs.read_documents(spark, root, "weather")
    assert none[0].count() == none[1].count() == 0


def test_season_job_from_landed_files(spark, tmpdir_fresh):
    from trackside.plans.jobs import season_landed_job
    root, target = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "store")
    at = lambda s: f"2025-03-15T05:00:{s:09.6f}+00:00"
    _land(root, "sessions", [{"session_key": 9, "session_name": "Qualifying", "country_name": "Australia", "location": "Melbourne", "year": 2025}])
    _land(root, "drivers", [{"session_key": 9, "driver_number": 1, "name_acronym": "VER"}])
    _land(root, "laps", [{"session_key": 9, "driver_number": 1, "lap_number": 1, "date_start": at(0), "lap_duration": 9.0}])
    _land(root, "car_data", [{"session_key": 9, "driver_number": 1, "date": at(s), "speed": 100 + s} for s in (1, 2, 3, 30)]
          + [{"session_key": 9, "driver_number": 1, "date": at(4), "speed": "fast"}])
    with gzip.open(os.path.join(tmpdir_fresh, "schedule.csv.gz"), "wt") as f:
        f.write("Unnamed: 0,RoundNumber,Country,Location,EventDate\n0,1,Australia,Melbourne,2025-03-16\n")
    rejects, pre = os.path.join(tmpdir_fresh, "rejects"), os.path.join(tmpdir_fresh, "previews")
    job = dict(target=target, as_of="2025-12-31", rejects_path=rejects, preview_path=pre)
    status = season_landed_job(spark, root, os.path.join(tmpdir_fresh, "schedule.csv"), **job).collect()
    assert [(r.Round, r.q_ok, r.stored_rows) for r in status] == [(1, True, 3)]
    assert [r.Speed for r in read_store(spark, target).orderBy("TimeInLap").collect()] == [101.0, 102.0, 103.0]
    assert [r.reason for r in spark.read.parquet(rejects + "/documents").collect()] == ["row"]
    assert [(r.reason, r["count"]) for r in spark.read.parquet(rejects + "/samples").collect()] == [("sample_no_lap", 1)]
    assert spark.read.option("header", True).csv(pre).count() == 3
    season_landed_job(spark, root, os.path.join(tmpdir_fresh, "schedule.csv"), **job)
    assert live_sessions(spark, target).count() == 1 and spark.read.parquet(rejects + "/samples").count() == 1


def test_two_seasons_and_session_types(spark):
    from trackside.operators.sessions import session_predicate
    from trackside.plans.ingest import api_ingest, api_ingest_rejects
    t = datetime(2025, 3, 15, 5)
    sessions = spark.createDataFrame(
        [(1, "Qualifying", "Australia", "Melbourne", 2024), (2, "Qualifying", "Australia", "Melbourne", 2025),
         (3, "Race", "Australia", "Melbourne", 2025), (4, "Qualifying", "Atlantis", "Deep", 2025)],
        "session_key long, session_name string, country_name string, location string, year int")
    schedule = spark.createDataFrame([("Australia", "Melbourne", 3, "2024-03-24"), ("Australia", "Melbourne", 1, "2025-03-16")],
                                     "Country string, Location string, RoundNumber int, EventDate string")
    keys = [1, 2, 3, 4]
    laps = spark.createDataFrame([(k, 1, n, t + timedelta(seconds=10 * n), 10.0, None, None, None, n == 1)
                                  for k in keys for n in (1, 2)],
                                 "session_key long, driver_number int, lap_number int, date_start timestamp, lap_duration double, "
                                 "duration_sector_1 double, duration_sector_2 double, duration_sector_3 double, is_pit_out_lap boolean")
    car = [(k, 1, t + timedelta(seconds=x), 1.0, 0.0, 1, 1.0, 100.0 + x, 3) for k in keys for x in (1, 12, 21, 22, 22, 23, 50)]
    car = spark.createDataFrame(car, api_docs._st(("session_key", api_docs._L), ("driver_number", api_docs._I), ("date", api_docs._TS),
                                                  ("throttle", api_docs._D), ("brake", api_docs._D), ("drs", api_docs._I),
                                                  ("rpm", api_docs._D), ("speed", api_docs._D), ("n_gear", api_docs._I)))
    stints = spark.createDataFrame([], api_docs.ENDPOINT_SCHEMAS["stints"])
    location = spark.createDataFrame([], api_docs.ENDPOINT_SCHEMAS["location"])
    drivers = spark.createDataFrame([(k, 1, a) for k in keys for a in ("VER", "AAA")],
                                    "session_key long, driver_number int, name_acronym string")
    for picked, want in ((None, {(2024, 3, "Q"): 4, (2025, 1, "Q"): 4, (2025, 1, "R"): 4}),
                         (session_predicate(name_equals="Qualifying"), {(2024, 3, "Q"): 4, (2025, 1, "Q"): 4})):
        tel = api_to_telemetry(sessions=sessions, drivers=drivers, laps=laps, stints=stints, car_data=car, location=location,
                               schedule=schedule, session_filter=picked)
        got = {(r.Year, r.Round, r.SessionType): r["n"]
               for r in tel.groupBy("Year", "Round", "SessionType").agg(F.count("*").alias("n")).collect()}
        assert got == want and {r.Driver for r in tel.select("Driver").distinct().collect()} == {"AAA"}
        rej = {}
        for r in api_ingest_rejects(sessions=sessions, laps=laps, car_data=car, schedule=schedule, session_filter=picked).collect():
            rej[r.session_key] = rej.get(r.session_key, 0) + r["count"]
        stored_by_key = {1: 4, 2: 4, 3: 4 if picked is None else 0, 4: 0}  # the repeated sample stays repeated
        assert {k: rej[k] + stored_by_key[k] for k in keys} == dict.fromkeys(keys, 7)  # rows in = stored + rejects
        both = api_ingest(sessions=sessions, drivers=drivers, laps=laps, stints=stints, car_data=car, location=location,
                          schedule=schedule, session_filter=picked)
        assert both[0].count() == sum(want.values())
        assert sum(r["count"] for r in both[1].collect()) == sum(rej.values())


def test_endpoint_documents_keep_all_their_fields(spark, tmpdir_fresh):
    _land(tmpdir_fresh, "session_result", [{"session_key": 9, "driver_number": 1, "position": 1, "points": 25.0, "dnf": False,
                                            "gap_to_leader": [0, 1.5, None], "duration": 5400.1, "number_of_laps": 57}])
    r = api_docs.read_endpoint(spark, tmpdir_fresh, "session_result").first()
    assert (r.points, r.dnf, r.number_of_laps, r.duration, r.gap_to_leader.replace(" ", "")) == (25.0, False, 57, "5400.1", "[0,1.5,null]")


def test_telemetry_from_csv_files(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "raw.csv")
    pdf = _raw(spark, [1]).toPandas()
    pdf.to_csv(path + ".gz", index=False)
    t = files.load_telemetry(spark, os.path.join(tmpdir_fresh, "processed.csv"), path, schema=_raw(spark, [1]).schema)
    assert t.count() == 5 and "Acceleration" in t.columns


def _land(root, endpoint, docs):
    d = os.path.join(root, f"endpoint={endpoint}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part.json"), "w") as f:
        json.dump(docs, f)


def test_api_documents_to_telemetry(spark, tmpdir_fresh):
    root = tmpdir_fresh
    t0 = "2025-03-15T05:00:00"
    def at(s):
        return (pd.Timestamp(t0, tz="UTC") + pd.Timedelta(seconds=s)).isoformat()
    _land(root, "sessions", [{"session_key": 9, "session_name": "Qualifying", "country_name": "Australia",
                              "location": "Melbourne", "year": 2025}])
    _land(root, "drivers", [{"session_key": 9, "driver_number": 1, "name_acronym": "VER"}])
    _land(root, "laps", [
        {"session_key": 9, "driver_number": 1, "lap_number": 1, "date_start": at(0), "lap_duration": 2.0,
         "duration_sector_1": 1.0, "duration_sector_2": 0.5, "duration_sector_3": 0.5, "is_pit_out_lap": True},
        {"session_key": 9, "driver_number": 1, "lap_number": 2, "date_start": at(2), "lap_duration": 2.0,
         "duration_sector_1": 1.0, "duration_sector_2": 0.5, "duration_sector_3": None, "is_pit_out_lap": None}])
    _land(root, "stints", [{"session_key": 9, "driver_number": 1, "stint_number": 1, "lap_start": 1,
                            "compound": "SOFT"}, {"session_key": 9, "driver_number": 1, "stint_number": 2,
                                                  "lap_start": 2, "lap_end": 3, "compound": "HARD"}])
    _land(root, "car_data", [{"session_key": 9, "driver_number": 1, "date": at(s), "throttle": 99,
                              "brake": b, "drs": 0, "rpm": 11000, "speed": 300 - s, "n_gear": 7}
                             for s, b in [(0.5, 0), (2.5, 100), (3.0, 0), (3.9, 0)]])
    _land(root, "location", [{"session_key": 9, "driver_number": 1, "date": at(s), "x": s, "y": 1.0, "z": 0.0}
                             for s in (2.45, 3.25)])
    sched = spark.createDataFrame([("Australia", "Melbourne", 1)], "Country string, Location string, RoundNumber int")
    ep = {e: api_docs.read_endpoint(spark, root, e)
          for e in ("sessions", "drivers", "laps", "stints", "car_data", "location")}
    tel = api_to_telemetry(sessions=ep["sessions"], drivers=ep["drivers"], laps=ep["laps"], stints=ep["stints"],
                           car_data=ep["car_data"], location=ep["location"], schedule=sched)
    got = tel.orderBy("TimeInLap").collect()
    # lap 1 is a pit-out lap (dropped); lap 2 keeps the three samples from 2.5 s
    assert [r.LapNumber for r in got] == [2, 2, 2]
    assert [r.TimeInLap for r in got] == [0.0, 0.5, 1.4]
    assert [r.X for r in got] == [2.45, None, None]     # 3.0 is 0.25 s from 3.25 -> beyond 200 ms
    assert got[0].Brake is True and got[1].Brake is False and got[0].Driver == "VER" and got[0].Round == 1
    assert got[0].Compound == "HARD" and got[0].FreshTyre is True
    assert got[0].LapTime == "0 days 00:00:02.000000" and got[0].Sector3Time is None
    assert tel.columns[:6] == S.CANONICAL_COLUMNS[:6]
    assert api_docs.read_endpoint(spark, root, "weather").count() == 0
    from trackside.plans.ingest import api_ingest_rejects
    rej = {r.reason: r["count"] for r in api_ingest_rejects(sessions=ep["sessions"], laps=ep["laps"],
                                                            car_data=ep["car_data"], schedule=sched).collect()}
    # the 0.5 s sample lies in pit-out lap 1; the others are inside lap 2 (2.0 s to 4.0 s)
    assert rej == {"sample_pit_out": 1}


def test_season_summaries_union_and_completed(spark):
    from trackside.plans.jobs import season_summaries
    sched = spark.createDataFrame([(0, "2025-02-28"), (1, "2025-03-16"), (2, None), (3, "2025-12-07")],
                                  "RoundNumber int, EventDate string")
    race = spark.createDataFrame([("VER", 1, "0 days 00:01:20.000000", "SOFT", True)],
                                 "Driver string, LapNumber int, LapTime string, Compound string, FreshTyre boolean")
    quali = spark.createDataFrame([("NOR", 2, "0:01:19.500000", True)],
                                  "Driver string, LapNumber int, LapTime string, IsPersonalBest boolean")
    out = season_summaries(sched, {"Race": race, "Qualifying": quali}, as_of="2025-06-01")
    assert [r.RoundNumber for r in out["schedule"].collect()] == [1]
    laps = {r.SessionType: r for r in out["laps"].collect()}
    assert laps["Race"].IsPersonalBest is None and laps["Qualifying"].Compound is None
    assert laps["Qualifying"].LapTime_seconds == 79.5
    # with rounds and event names, every table keeps its columns and completed rounds only
    full = season_summaries(sched.withColumn("EventName", F.lit("GP")), {
        "Race": race.withColumn("Round", F.lit(1)).withColumn("Extra", F.lit(0)),
        "Qualifying": quali.withColumn("Round", F.lit(3))}, as_of="2025-06-01")["laps"]
    assert [(r.Driver, r.Round, r.EventName, r.SessionType) for r in full.collect()] == [("VER", 1, "GP", "Race")]
    assert "Extra" not in full.columns and "IsPersonalBest" in full.columns


def test_csv_export_gzip_roundtrip_and_optional_sources(spark, tmpdir_fresh):
    out = os.path.join(tmpdir_fresh, "export")
    sinks.write_csv(_raw(spark, [1]), out, compress=True)
    assert any(f.endswith(".csv.gz") for f in os.listdir(out))
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 5
    missing = files.read_optional(spark, os.path.join(tmpdir_fresh, "nope"), "Driver string, Cluster int")
    assert missing.count() == 0 and missing.columns == ["Driver", "Cluster"]
    assert not sinks.publish_summary(spark.createDataFrame([], "a int"), os.path.join(tmpdir_fresh, "empty"))
    assert not os.path.exists(os.path.join(tmpdir_fresh, "empty"))
    assert sinks.publish_summary(_raw(spark, [1]), os.path.join(tmpdir_fresh, "summ"))
    sinks.write_run_summary(spark, os.path.join(tmpdir_fresh, "run"), n_rounds=2, silhouette_score=0.1234)
    assert json.loads(spark.read.text(os.path.join(tmpdir_fresh, "run")).first()[0])["n_rounds"] == 2


def test_load_telemetry_processed_else_raw(spark, tmpdir_fresh):
    raw = os.path.join(tmpdir_fresh, "raw")
    _raw(spark, [1]).write.parquet(raw)
    t = files.load_telemetry(spark, os.path.join(tmpdir_fresh, "processed"), raw)
    assert "Acceleration" in t.columns and t.count() == 5
    with __import__("pytest").raises(FileNotFoundError):
        files.load_telemetry(spark, os.path.join(tmpdir_fresh, "processed"))


def test_session_predicates_and_union(spark):
    from trackside.operators.sessions import session_predicate, union_by_name
    s = spark.createDataFrame([(1, "Race", "Race"), (2, "Sprint Race", "Race"), (3, "Qualifying", "Qualifying"),
                               (4, "Practice 3", "Practice")], "k int, session_name string, session_type string")
    assert sorted(r.k for r in s.filter(session_predicate(name_contains="Race")).collect()) == [1, 2]
    assert sorted(r.k for r in s.filter(session_predicate(types=["Qualifying", "Race"])).collect()) == [1, 2, 3]
    assert [r.k for r in s.filter(session_predicate(name_equals="Qualifying")).collect()] == [3]
    u = union_by_name([s.select("k"), s.select("k", "session_type")])
    assert u.count() == 8 and u.filter("session_type IS NULL").count() == 4
