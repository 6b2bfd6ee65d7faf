"""Queries: as-of join, lap assignment, stints, lap attributes, time in lap,
pit-out filter, round mapping, semi joins, completed rounds and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import align, laps
from trackside.plans.registry import register
from trackside.plans.sqlfrag import KEYS, LAPK
from trackside.sources.adapter import read_table, telemetry_view

HOUR = 3600.0


def _events(spark, sf):
    return read_table(spark, sf, "events")


# --------------------------------------------------------------------------- #
# JN-1: every `view` event <- nearest `click` of the same user within 1 hour
# --------------------------------------------------------------------------- #
ASOF_SQL = """
v AS (SELECT event_id AS view_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
c AS (SELECT event_id AS click_id, user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'click'),
cand AS (
  SELECT v.view_id, c.click_id, c.value, abs(v.us - c.us) AS d, c.us > v.us AS fwd,
         CASE WHEN c.us > v.us THEN c.click_id ELSE -c.click_id END AS tb
  FROM v JOIN c ON v.user_id = c.user_id AND c.us BETWEEN v.us - 3600000000 AND v.us + 3600000000),
best AS (
  SELECT view_id, arg_min(click_id, (d, fwd, tb)) AS click_id, arg_min(value, (d, fwd, tb)) AS click_value
  FROM cand GROUP BY view_id)"""


@register("asof_nearest", ASOF_SQL + """
---
SELECT v.view_id, v.user_id, b.click_id, b.click_value FROM v LEFT JOIN best b USING (view_id)""", adapter=False)
def q_asof_nearest(spark, sf):
    ev = _events(spark, sf)
    views = ev.filter(F.col("event_type") == "view").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    clicks = ev.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"), "user_id", "ts", F.col("value").alias("click_value"))
    out = align.asof_nearest(views, clicks, by=["user_id"], left_ts="ts", right_ts="ts",
                             tolerance_seconds=HOUR, right_cols=["click_id", "click_value"],
                             right_order="click_id")
    return out.select("view_id", "user_id", "click_id", "click_value")


# --------------------------------------------------------------------------- #
# JN-2 / WN-5: `signup` events are lap starts (duration = value minutes, null
# when value < 10); every other event is a sample.
# --------------------------------------------------------------------------- #
def _laps(ev):
    return ev.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("event_id").alias("lap_number"), F.col("ts").alias("date_start"),
        F.when(F.col("value") >= 10, F.col("value") * 60.0).alias("lap_duration"),
        F.when(F.get_json_object("props", "$.k").cast("int") < 10, F.lit(True))
        .when(F.get_json_object("props", "$.k").cast("int") < 20, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False)).alias("is_pit_out_lap"))


LAPS_SQL = """
laps AS (
  SELECT user_id, event_id AS lap_number, epoch_us(ts) AS s_us,
         CASE WHEN value >= 10 THEN value * 60.0 END AS dur,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN true
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 20 THEN NULL ELSE false END AS is_pit_out_lap
  FROM events WHERE event_type = 'signup'),
lape AS (
  SELECT *, CASE WHEN dur > 0 THEN s_us + CAST(floor(dur * 1000000.0 + 0.5) AS BIGINT)
                 WHEN nxt IS NOT NULL THEN nxt ELSE s_us + 180000000 END AS e_us,
            CASE WHEN dur > 0 THEN 'duration' WHEN nxt IS NOT NULL THEN 'next_start' ELSE 'fallback' END AS end_source
  FROM (SELECT *, lead(s_us) OVER (PARTITION BY user_id ORDER BY s_us, lap_number) AS nxt FROM laps)),
smp AS (SELECT event_id, user_id, epoch_us(ts) AS us, ts FROM events WHERE event_type <> 'signup'),
asg AS (
  SELECT s.event_id, s.user_id, s.us, arg_max(l.lap_number, (l.s_us, l.lap_number)) AS "LapNumber"
  FROM smp s JOIN lape l ON s.user_id = l.user_id AND s.us BETWEEN l.s_us AND l.e_us
  GROUP BY s.event_id, s.user_id, s.us)"""


def _assigned(spark, sf, sample_cols=("event_id", "user_id", "ts")):
    ev = _events(spark, sf)
    samples = ev.filter(F.col("event_type") != "signup").select(*sample_cols)
    return align.assign_laps(samples, _laps(ev), by=["user_id"], sample_ts="ts", bucket_seconds=86400.0)


@register("lap_end_fallback", LAPS_SQL + """
---
SELECT user_id, lap_number, s_us AS start_us, e_us AS end_us, end_source FROM lape""", adapter=False)
def q_lap_end_fallback(spark, sf):
    lw = align.lap_windows(_laps(_events(spark, sf)), by=["user_id"])
    return lw.select("user_id", "lap_number", F.col("_start_us").alias("start_us"),
                     F.col("_end_us").alias("end_us"), "end_source")


@register("assign_laps", LAPS_SQL + """
---
SELECT event_id, user_id, "LapNumber" FROM asg""", adapter=False)
def q_assign_laps(spark, sf):
    return _assigned(spark, sf).select("event_id", "user_id", "LapNumber")


@register("time_in_lap", LAPS_SQL + """
---
SELECT event_id, user_id, "LapNumber",
       (us - min(us) OVER (PARTITION BY user_id, "LapNumber")) / 1000000.0 AS "TimeInLap" FROM asg""", adapter=False)
def q_time_in_lap(spark, sf):
    a = _assigned(spark, sf)
    t = align.time_in_lap(a, lap_keys=["user_id", "LapNumber"], ts="ts")
    return t.select("event_id", "user_id", "LapNumber", "TimeInLap")


@register("drop_pit_out", LAPS_SQL + """
---
SELECT a.event_id, a.user_id, a."LapNumber" FROM asg a
JOIN laps l ON a.user_id = l.user_id AND a."LapNumber" = l.lap_number
WHERE NOT COALESCE(l.is_pit_out_lap, false)""", adapter=False)
def q_drop_pit_out(spark, sf):
    ev = _events(spark, sf)
    a = _assigned(spark, sf)
    meta = _laps(ev).select("user_id", F.col("lap_number").alias("LapNumber"), "is_pit_out_lap")
    j = align.attach_lap_attributes(a, meta, keys=["user_id", "LapNumber"])
    return align.drop_pit_out_laps(j).select("event_id", "user_id", "LapNumber")


# --------------------------------------------------------------------------- #
# JN-3 / JN-4: stints derived from each user's laps 0 and 1 of the adapter.
# stint_order = lap; lap_end = lap + user_id % 2 (null when user_id % 5 = 0),
# so odd users have overlapping stints and lap 2 of even users has none.
# --------------------------------------------------------------------------- #
def _stints(lap_tab):
    u = F.col("Driver").cast("long")
    return lap_tab.filter(F.col("LapNumber") < 2).select(
        *S.SESSION_KEYS, "Driver", F.col("LapNumber").alias("stint_order"),
        F.col("LapNumber").alias("lap_start"),
        F.when(F.pmod(u, F.lit(5)) == 0, F.lit(None).cast("int"))
        .otherwise(F.col("LapNumber") + F.pmod(u, F.lit(2)).cast("int")).alias("lap_end"),
        F.col("Compound").alias("compound"))


STINT_SQL = f"""
lt AS (SELECT DISTINCT {LAPK}, "Compound" FROM tel),
st AS (SELECT {KEYS}, "Driver", "LapNumber" AS stint_order, "LapNumber" AS lap_start,
              CASE WHEN CAST("Driver" AS BIGINT) % 5 = 0 THEN NULL ELSE "LapNumber" + CAST("Driver" AS BIGINT) % 2 END AS lap_end,
              "Compound" AS compound FROM lt WHERE "LapNumber" < 2),
sc AS (
  SELECT l.{KEYS.replace(', ', ', l.')}, l."Driver", l."LapNumber",
         arg_min(s.compound, s.stint_order) AS "Compound", CASE WHEN count(s.stint_order) > 0 THEN true END AS "FreshTyre"
  FROM lt l LEFT JOIN st s ON l."Driver" = s."Driver" AND l."Round" = s."Round"
       AND l."LapNumber" BETWEEN s.lap_start AND COALESCE(s.lap_end, s.lap_start)
  GROUP BY ALL)"""


def _stint_table(spark, sf):
    lt = laps.lap_table(telemetry_view(spark, sf), attrs=["Compound"]).select(*S.LAP_KEYS, "Compound")
    return align.stint_compounds(lt.drop("Compound"), _stints(lt), by=[*S.SESSION_KEYS, "Driver"])


@register("stint_lookup", STINT_SQL + f"""
---
SELECT {LAPK}, "Compound", "FreshTyre" FROM sc""")
def q_stint_lookup(spark, sf):
    return _stint_table(spark, sf).select(*S.LAP_KEYS, "Compound", "FreshTyre")


@register("lap_attributes", STINT_SQL + f"""
---
SELECT t.sample_id, t."Driver", t."LapNumber", sc."Compound", sc."FreshTyre"
FROM tel t JOIN sc USING ({LAPK}) WHERE sc."FreshTyre" IS NOT NULL""")
def q_lap_attributes(spark, sf):
    st = _stint_table(spark, sf).filter(F.col("FreshTyre").isNotNull())
    tel = telemetry_view(spark, sf).select(*S.LAP_KEYS, "sample_id")
    j = align.attach_lap_attributes(tel, st, keys=S.LAP_KEYS)
    return j.select("sample_id", "Driver", "LapNumber", "Compound", "FreshTyre")


# --------------------------------------------------------------------------- #
# JN-5: customers -> "round" through (region name, nation name); the schedule
# is nation x region (RoundNumber = nationkey + 1) plus duplicates of every 5th
# nation with RoundNumber + 100 (last row wins); customers with custkey % 10 = 0
# carry an unknown location.
# --------------------------------------------------------------------------- #
def _schedule(spark, sf):
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    base = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("Country"), F.col("n_name").alias("Location"),
        (F.col("n_nationkey") + 1).alias("RoundNumber"))
    dup = n.join(r, n.n_regionkey == r.r_regionkey).filter(F.pmod("n_nationkey", F.lit(5)) == 0).select(
        F.col("r_name").alias("Country"), F.col("n_name").alias("Location"),
        (F.col("n_nationkey") + 101).alias("RoundNumber"))
    return base.unionByName(dup)


def _sessions(spark, sf):
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select("c_custkey", F.col("r_name").alias("country_name"),
                    F.when(F.pmod("c_custkey", F.lit(10)) == 0, F.lit("Unknown"))
                    .otherwise(F.col("n_name")).alias("location")))


RM_SQL = """
sched AS (
  SELECT r_name AS country, n_name AS location, n_nationkey + 1 AS rn FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT r_name, n_name, n_nationkey + 101 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0),
sched1 AS (SELECT country, location, max(rn) AS "RoundNumber" FROM sched GROUP BY ALL),
sess AS (
  SELECT c_custkey, r_name AS country_name, CASE WHEN c_custkey % 10 = 0 THEN 'Unknown' ELSE n_name END AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@register("round_map", RM_SQL + """
---
SELECT s.c_custkey, s.country_name, s.location, d."RoundNumber"
FROM sess s JOIN sched1 d ON s.country_name = d.country AND s.location = d.location""", adapter=False)
def q_round_map(spark, sf):
    m, _ = align.map_rounds(_sessions(spark, sf), _schedule(spark, sf),
                            session_key=["country_name", "location"], schedule_key=["Country", "Location"])
    return m.select("c_custkey", "country_name", "location", "RoundNumber")


@register("round_map_missing", RM_SQL + """
---
SELECT s.c_custkey, s.country_name, s.location FROM sess s
WHERE NOT EXISTS (SELECT 1 FROM sched1 d WHERE s.country_name = d.country AND s.location = d.location)""",
          adapter=False)
def q_round_map_missing(spark, sf):
    _, miss = align.map_rounds(_sessions(spark, sf), _schedule(spark, sf),
                               session_key=["country_name", "location"], schedule_key=["Country", "Location"])
    return miss.select("c_custkey", "country_name", "location")


@register("session_semi", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))""",
          adapter=False)
def q_session_semi(spark, sf):
    """JN-9 + FLT-6: facts of the selected sessions (customers of two segments)."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = read_table(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return align.semi_filter(o, c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


AS_OF_DATE = "1996-06-30"


@register("completed_rounds", f"""
SELECT o_orderkey, CAST(o_orderkey % 25 AS INTEGER) AS "RoundNumber", CAST(o_orderdate AS DATE) AS "EventDate"
FROM orders WHERE o_orderkey % 25 > 0 AND o_orderdate IS NOT NULL AND CAST(o_orderdate AS DATE) <= DATE '{AS_OF_DATE}'""",
          adapter=False)
def q_completed_rounds(spark, sf):
    """FLT-4/5 over a schedule-shaped view of orders (round = key mod 25, round 0
    = testing, event date = order date) with an explicit as-of date."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.pmod("o_orderkey", F.lit(25)).cast("int").alias("RoundNumber"),
        F.to_date("o_orderdate").alias("EventDate"))
    from trackside.operators.sessions import completed_rounds
    return completed_rounds(o, as_of=AS_OF_DATE)


@register("union_sessions", """
SELECT o_orderkey AS "LapNumber", CAST(o_custkey AS VARCHAR) AS "Driver", 'Race' AS "SessionType",
       o_orderpriority AS "Compound", CAST(NULL AS BOOLEAN) AS "IsPersonalBest", o_totalprice / 1000.0 AS "LapTime_seconds"
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, CAST(o_custkey AS VARCHAR), 'Qualifying', NULL, o_totalprice > 100000.0, o_totalprice / 1000.0
FROM orders WHERE o_orderstatus = 'O'
UNION ALL
SELECT o_orderkey, CAST(o_custkey AS VARCHAR), 'FP3', o_orderpriority, NULL, o_totalprice / 1000.0
FROM orders WHERE o_orderstatus = 'P'""", adapter=False)
def q_union_sessions(spark, sf):
    """ST-2 / PRJ-3 / PRJ-5: three session tables with different columns, unioned
    by name with missing columns as typed nulls."""
    from trackside.operators.sessions import union_by_name
    o = read_table(spark, sf, "orders")
    base = [F.col("o_orderkey").alias("LapNumber"), F.col("o_custkey").cast("string").alias("Driver"),
            (F.col("o_totalprice") / 1000.0).alias("LapTime_seconds")]
    race = o.filter(F.col("o_orderstatus") == "F").select(*base, F.lit("Race").alias("SessionType"),
                                                           F.col("o_orderpriority").alias("Compound"))
    quali = o.filter(F.col("o_orderstatus") == "O").select(*base, F.lit("Qualifying").alias("SessionType"),
                                                            (F.col("o_totalprice") > 100000.0).alias("IsPersonalBest"))
    fp3 = o.filter(F.col("o_orderstatus") == "P").select(*base, F.lit("FP3").alias("SessionType"),
                                                          F.col("o_orderpriority").alias("Compound"))
    return union_by_name([race, quali, fp3]).select("LapNumber", "Driver", "SessionType", "Compound",
                                                    "IsPersonalBest", "LapTime_seconds")
