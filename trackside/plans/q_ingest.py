"""Queries: landed documents to telemetry (PL-2), rejects, the season job with its store
(PL-7, SNK-1/2/3/8/9), session and driver filters, sector texts.

The landed documents are shaped from ``events`` and ``nation``: session = user_id % 4,
driver = user_id, signups are laps, views car samples, clicks positions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackside.functions.durations import seconds_to_duration_text
from trackside.operators.sessions import session_predicate
from trackside.operators.summaries import filter_drivers
from trackside.plans.ingest import api_ingest_rejects, api_to_telemetry, landed_laps_to_telemetry
from trackside.plans.jobs import api_summaries, season_api_job, season_results
from trackside.plans.q_align import ASOF_SQL, HOUR, LAPS_SQL
from trackside.plans.registry import register
from trackside.session import shared_dir
from trackside.sources import files, sinks
from trackside.sources.adapter import read_table, telemetry_view
from trackside.sources.store import read_store


def _documents(spark, sf):
    """Session 2 has no round; session 3 is a race; the two seasons number rounds differently."""
    ev = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int"))
    key = [F.pmod("user_id", F.lit(4)).cast("long").alias("session_key"), F.col("user_id").cast("int").alias("driver_number")]
    nation = read_table(spark, sf, "nation")
    signup, view, click = (ev.filter(F.col("event_type") == t) for t in ("signup", "view", "click"))
    dur = F.when(F.col("value") >= 10, F.col("value") * 60.0)
    docs = {
        "sessions": nation.filter("n_nationkey < 4").select(
            F.col("n_nationkey").cast("long").alias("session_key"),
            F.when(F.col("n_nationkey") == 3, F.lit("Race")).otherwise(F.lit("Qualifying")).alias("session_name"),
            F.col("n_name").alias("country_name"), F.lit("Town").alias("location"),
            (F.col("n_nationkey") % 2 + 2024).cast("int").alias("year")),
        "drivers": ev.select(*key, F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("name_acronym")).distinct(),
        "laps": signup.select(
            *key, F.col("event_id").cast("int").alias("lap_number"), F.col("ts").alias("date_start"), dur.alias("lap_duration"),
            (dur / 4).alias("duration_sector_1"), F.lit(0.0).alias("duration_sector_2"),
            F.lit(None).cast("double").alias("duration_sector_3"),
            F.when(F.col("k") < 10, F.lit(True)).when(F.col("k") >= 20, F.lit(False)).alias("is_pit_out_lap")),
        "stints": signup.filter("event_id % 2 = 0").select(
            *key, F.col("event_id").cast("int").alias("stint_number"), F.col("event_id").cast("int").alias("lap_start"),
            F.lit(None).cast("int").alias("lap_end"), F.concat(F.lit("C"), (F.col("k") % 3).cast("string")).alias("compound")),
        "car_data": view.select(
            *key, F.col("ts").alias("date"), F.col("k").cast("double").alias("throttle"),
            F.when(F.col("k") % 5 > 0, F.when(F.col("value") > 100, 100.0).otherwise(0.0)).alias("brake"),
            (F.col("k") % 2).alias("drs"), (F.col("value") * 10 + 9000).alias("rpm"), F.col("value").alias("speed"),
            (F.col("k") % 8).alias("n_gear")),
        "location": click.select(*key, F.col("ts").alias("date"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
                                 F.lit(0.0).alias("z")),
    }
    schedule = nation.filter("n_nationkey <> 2").select(
        F.col("n_name").alias("Country"), F.lit("Town").alias("Location"), F.explode(F.array(
            F.struct((F.col("n_nationkey") + 1).alias("RoundNumber"), F.lit("2024-05-05").alias("EventDate")),
            F.struct((F.col("n_nationkey") + 11).alias("RoundNumber"), F.lit("2025-05-05").alias("EventDate")))).alias("r")
    ).select("Country", "Location", "r.*")
    return docs, schedule


_TEXT = "printf('%d days %02d:%02d:%02d.%06d', us // 86400000000, (us // 3600000000) % 24, (us // 60000000) % 60, " \
        "(us // 1000000) % 60, us % 1000000)"


def _text(seconds: str) -> str:
    return _TEXT.replace("us", f"CAST(floor(({seconds}) * 1000000.0 + 0.5) AS BIGINT)")


API_SQL = ASOF_SQL.strip() + "," + LAPS_SQL + f""",
car AS (SELECT event_id, user_id, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type = 'view'),
kept AS (
  SELECT c.*, a."LapNumber", l.dur FROM car c JOIN asg a USING (event_id)
  JOIN laps l ON l.user_id = c.user_id AND l.lap_number = a."LapNumber"
  WHERE c.user_id % 4 <> 2 AND NOT COALESCE(l.is_pit_out_lap, false)),
api AS (
  SELECT CAST(2024 + user_id % 4 % 2 AS INTEGER) AS "Year",
         CAST(user_id % 4 + CASE WHEN user_id % 4 % 2 = 0 THEN 1 ELSE 11 END AS INTEGER) AS "Round",
         CASE WHEN user_id % 4 = 3 THEN 'R' ELSE 'Q' END AS "SessionType",
         CAST(user_id AS VARCHAR) AS "DriverNumber", 'D' || user_id AS "Driver", CAST("LapNumber" AS INTEGER) AS "LapNumber",
         (us - min(us) OVER (PARTITION BY user_id, "LapNumber")) / 1000000.0 AS "TimeInLap",
         CAST(k AS DOUBLE) AS "Throttle", CASE WHEN k % 5 > 0 THEN value > 100 END AS "Brake", k % 2 AS "DRS",
         value AS "Speed", k % 8 AS "Gear", b.click_value AS "X",
         CASE WHEN dur > 0 THEN {_text('dur')} END AS "LapTime",
         CASE WHEN dur IS NOT NULL THEN {_text('dur / 4')} END AS "Sector1Time",
         {_text('0.0')} AS "Sector2Time", CAST(NULL AS VARCHAR) AS "Sector3Time",
         CASE WHEN "LapNumber" % 2 = 0 THEN 'C' || (SELECT CAST(json_extract_string(e.props, '$.k') AS INTEGER) % 3
              FROM events e WHERE e.event_id = kept."LapNumber") END AS "Compound",
         CASE WHEN "LapNumber" % 2 = 0 THEN true END AS "FreshTyre"
  FROM kept LEFT JOIN best b ON b.view_id = kept.event_id)"""
_API_COLUMNS = ["Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber", "TimeInLap", "Throttle", "Brake", "DRS",
                "Speed", "Gear", "X", "LapTime", "Sector1Time", "Sector2Time", "Sector3Time", "Compound", "FreshTyre"]
_INGEST = {"tolerance_seconds": HOUR, "lap_bucket_seconds": 86400.0}


@register("api_telemetry", API_SQL + "\n---\nSELECT " + ", ".join(f'"{c}"' for c in _API_COLUMNS) + " FROM api", adapter=False)
def q_api_telemetry(spark, sf):
    """PL-2 with PRJ-2, PRJ-4, SC-14, SC-17: two seasons, two session types, one session without a round."""
    docs, schedule = _documents(spark, sf)
    return api_to_telemetry(schedule=schedule, **docs, **_INGEST).select(*_API_COLUMNS)


@register("api_rejects", API_SQL + """
---
SELECT session_key, reason, count(*) AS count FROM (
  SELECT CAST(c.user_id % 4 AS BIGINT) AS session_key,
         CASE WHEN c.user_id % 4 = 2 THEN 'session_unmatched' WHEN a.event_id IS NULL THEN 'sample_no_lap'
              WHEN l.is_pit_out_lap THEN 'sample_pit_out' END AS reason
  FROM car c LEFT JOIN asg a USING (event_id)
  LEFT JOIN laps l ON l.user_id = c.user_id AND l.lap_number = a."LapNumber")
WHERE reason IS NOT NULL GROUP BY ALL""", adapter=False)
def q_api_rejects(spark, sf):
    """What PL-2 leaves out, by session and reason."""
    docs, schedule = _documents(spark, sf)
    return api_ingest_rejects(sessions=docs["sessions"], laps=docs["laps"], car_data=docs["car_data"], schedule=schedule,
                              lap_bucket_seconds=86400.0)


def _shared(spark, name):
    """A fresh folder in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("season_store", API_SQL + """
---
SELECT "Year", "Round", bool_or("SessionType" = 'Q') AS q_ok, bool_or("SessionType" = 'R') AS r_ok,
       count(DISTINCT "SessionType") AS processed_sessions, count(*) AS "Rows", 0::BIGINT AS "Left", true AS "Unchanged"
FROM api WHERE "Year" = 2024 OR "Year" = 2025 GROUP BY ALL""", adapter=False)
def q_season_store(spark, sf):
    """PL-7: the season job writes the store and its manifest; a second run finds nothing left to write."""
    docs, schedule = _documents(spark, sf)
    store = _shared(spark, "season")
    job = dict(schedule=schedule, target=f"{store}/telemetry", as_of="2025-12-31", docs=docs, preview_path=f"{store}/preview")
    season_api_job(spark, **job, **_INGEST)
    first = set(read_store(spark, job["target"]).inputFiles())
    manifest = season_api_job(spark, **job, **_INGEST)
    same = first == set(read_store(spark, job["target"]).inputFiles())
    rows = read_store(spark, job["target"]).groupBy("Year", "Round").agg(F.count(F.lit(1)).alias("Rows"))
    left = manifest.filter("processed_sessions = 0").count()
    return manifest.drop("stored_rows").join(rows, ["Year", "Round"]).withColumn("Left", F.lit(left).cast("long")).withColumn("Unchanged", F.lit(same))


@register("session_predicate", """
SELECT o_orderkey FROM orders WHERE contains(o_orderpriority, 'URGENT') AND o_orderstatus IN ('F', 'O')
UNION ALL
SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW'""", adapter=False)
def q_session_predicate(spark, sf):
    """FLT-6 on orders as sessions: name contains + type in, and name equals."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("session_name"),
                                               F.col("o_orderstatus").alias("session_type"))
    return (o.filter(session_predicate(name_contains="URGENT", types=["F", "O"]))
            .unionByName(o.filter(session_predicate(name_equals="5-LOW"))).select("o_orderkey"))


@register("filter_drivers", """
SELECT sample_id, "Driver" FROM tel WHERE "Driver" IN ('1', '7', '12', 'nobody')
UNION ALL
SELECT sample_id, "Driver" FROM tel WHERE "Driver" IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 3)""")
def q_filter_drivers(spark, sf):
    """FLT-2: a list of drivers, and a table of drivers."""
    tel = telemetry_view(spark, sf).select("sample_id", "Driver")
    chosen = read_table(spark, sf, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").cast("string").alias("Driver"))
    return filter_drivers(tel, ["1", "7", "12", "nobody"]).unionByName(filter_drivers(tel, chosen))


@register("sector_text", f"""
e AS (SELECT event_id, event_id % 5 * 30.25 + event_id % 3 * 3600 AS sec FROM events)
---
SELECT event_id, CASE WHEN sec <> 0 THEN {_text('sec')} END AS lap, {_text('sec')} AS sector FROM e""", adapter=False)
def q_sector_text(spark, sf):
    """SC-14: 0 s is a missing lap time but a sector time of its own."""
    e = read_table(spark, sf, "events").select("event_id", (F.col("event_id") % 5 * 30.25 + F.col("event_id") % 3 * 3600).alias("sec"))
    return e.select("event_id", seconds_to_duration_text("sec").alias("lap"),
                    seconds_to_duration_text("sec", zero_is_missing=False).alias("sector"))


LANDED_SQL = """
s AS (SELECT event_id, 2024 AS "Year", CAST(user_id % 4 AS INTEGER) AS "Round", 'Q' AS "SessionType",
             CAST(user_id AS VARCHAR) AS "DriverNumber", CAST(floor((day(ts) - 1) / 10) AS INTEGER) AS "LapNumber",
             CASE WHEN event_id % 50 > 0 THEN epoch_us(ts) END AS us, value AS "Speed" FROM events),
l AS (SELECT "Year", "Round", "SessionType", "DriverNumber", "LapNumber", 'D' || "DriverNumber" AS "Driver",
             CASE WHEN "LapNumber" = 0 THEN 'SOFT' ELSE 'HARD' END AS "Compound", "LapNumber" = 0 AS "FreshTyre"
      FROM s WHERE "LapNumber" < 2 GROUP BY ALL)"""


def _landed(spark, sf):
    samples = read_table(spark, sf, "events").select(
        F.lit(2024).alias("Year"), F.pmod("user_id", F.lit(4)).cast("int").alias("Round"), F.lit("Q").alias("SessionType"),
        F.col("user_id").cast("string").alias("DriverNumber"),
        F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("LapNumber"),
        F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("Time"), F.col("value").alias("Speed"))
    laps = samples.filter("LapNumber < 2").select("Year", "Round", "SessionType", "DriverNumber", "LapNumber").distinct()
    laps = laps.withColumn("Driver", F.concat(F.lit("D"), "DriverNumber")).withColumn(
        "Compound", F.when(F.col("LapNumber") == 0, "SOFT").otherwise("HARD")).withColumn("FreshTyre", F.col("LapNumber") == 0)
    return landed_laps_to_telemetry(samples, laps)


@register("landed_telemetry", LANDED_SQL + """
---
SELECT "Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber", "Speed", "Compound", "FreshTyre",
       (us - min(us) OVER (PARTITION BY "Round", "DriverNumber", "LapNumber")) / 1000000.0 AS "TimeInLap"
FROM s JOIN l USING ("Year", "Round", "SessionType", "DriverNumber", "LapNumber") WHERE us IS NOT NULL""", adapter=False)
def q_landed_telemetry(spark, sf):
    """SRC-5: samples with lap attributes and time in lap."""
    return _landed(spark, sf)[0].select("Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber", "Speed", "Compound",
                                        "FreshTyre", "TimeInLap")


@register("landed_rejects", LANDED_SQL + """
---
SELECT "Year", "Round", "SessionType", CASE WHEN us IS NULL THEN 'no_time' ELSE 'no_lap' END AS reason, count(*) AS count
FROM s WHERE us IS NULL OR "LapNumber" >= 2 GROUP BY ALL""", adapter=False)
def q_landed_rejects(spark, sf):
    return _landed(spark, sf)[1]


@register("season_results", """
SELECT CAST(o_custkey AS VARCHAR) AS "DriverNumber", o_totalprice AS "Points", CAST(o_orderkey % 30 AS INTEGER) AS "Round",
       n_name AS "EventName" FROM orders JOIN nation ON n_nationkey = o_orderkey % 30 WHERE n_nationkey > 0""", adapter=False)
def q_season_results(spark, sf):
    """ST-3 / PRJ-3: results of every round of the schedule."""
    schedule = read_table(spark, sf, "nation").filter("n_nationkey > 0").select(
        F.col("n_nationkey").alias("RoundNumber"), F.col("n_name").alias("EventName"))
    results = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("DriverNumber"),
                                                     F.col("o_totalprice").alias("Points"), (F.col("o_orderkey") % 30).alias("Round"))
    return season_results(results, schedule)


@register("api_summaries", """
s AS (SELECT o_orderkey AS session_key, CASE WHEN o_orderstatus = 'F' THEN 'Sprint Race' ELSE 'Practice' END AS name,
             CASE WHEN o_orderstatus = 'F' THEN 'Race' WHEN o_orderstatus = 'O' THEN 'Qualifying' ELSE 'Practice' END AS kind FROM orders),
l AS (SELECT l_orderkey AS session_key, l_partkey AS driver_number FROM lineitem)
---
SELECT 'overtakes' AS "Table", session_key, driver_number FROM l JOIN (SELECT DISTINCT session_key FROM s WHERE name LIKE '%Race%') USING (session_key)
UNION ALL
SELECT 'starting_grid', session_key, driver_number FROM l JOIN (SELECT DISTINCT session_key FROM s WHERE kind IN ('Race', 'Qualifying')) USING (session_key)
UNION ALL
SELECT 'drivers', min(session_key), driver_number FROM l GROUP BY driver_number
UNION ALL
SELECT 'pit', session_key, driver_number FROM l""", adapter=False)
def q_api_summaries(spark, sf):
    """PL-8: sessions shaped from orders, their documents from lineitem."""
    status = F.col("o_orderstatus")
    sessions = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_key"), F.when(status == "F", "Sprint Race").otherwise("Practice").alias("session_name"),
        F.when(status == "F", "Race").when(status == "O", "Qualifying").otherwise("Practice").alias("session_type"))
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_key"), F.col("l_partkey").alias("driver_number"))
    tables = api_summaries({"sessions": sessions, **dict.fromkeys(("overtakes", "starting_grid", "drivers", "pit"), rows)})
    parts = [tables[t].select(F.lit(t).alias("Table"), "session_key", "driver_number")
             for t in ("overtakes", "starting_grid", "drivers", "pit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("csv_roundtrip", """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""", adapter=False)
def q_csv_roundtrip(spark, sf):
    """SNK-1 CSV export (gzip) read back by its plain name (SRC-1)."""
    cols = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    path = _shared(spark, "export")
    sinks.write_csv(read_table(spark, sf, "orders").select(*[c.split()[0] for c in cols.split(", ")]), f"{path}/orders.csv.gz",
                    compress=True)
    return files.read_csv(spark, f"{path}/orders.csv", cols)


@register("summary_roundtrip", """
SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'written', 1 UNION ALL SELECT 'skipped', 0""", adapter=False)
def q_summary_roundtrip(spark, sf):
    """SNK-4 (an empty summary is skipped), SNK-6 and SRC-6 (a missing table reads as an empty one)."""
    path, schema = _shared(spark, "summary"), "c_mktsegment string, n long"
    table = read_table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    done = {"written": sinks.publish_summary(table, f"{path}/segments"),
            "skipped": sinks.publish_summary(table.filter("n < 0"), f"{path}/none")}
    sinks.write_run_summary(spark, f"{path}/run", **done)
    run = spark.read.schema("written boolean, skipped boolean").json(f"{path}/run")
    flags = run.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("long").alias("v")) for k in done])).alias("f"))
    return (files.read_optional(spark, f"{path}/segments", schema).unionByName(files.read_optional(spark, f"{path}/none", schema))
            .unionByName(flags.select(F.col("f.k").alias("c_mktsegment"), F.col("f.v").alias("n"))))
