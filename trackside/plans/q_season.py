"""Queries: stores and files of a season. Landed documents with a quarantine (SRC-4, SC-13),
processed-session files (SRC-2, SC-10), schedule files (SRC-3), fallback loading (SRC-7), previews
per session (SNK-2), published runs (SNK-5), the lap-clustered table (SNK-1/3), the growing season
matrix (PL-5/6), display orders (TK-1), empty inputs (FLT-9), the clustering guard (ML-9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import charts, clustering, features, kinematics, laps, season_matrix, summaries
from trackside.plans.common import r6, round6
from trackside.plans.q_features import FEATS, ZSCORE_SQL, rdf
from trackside.plans.q_ingest import _shared
from trackside.plans.q_kinematics import ACC_SQL, ADAPTER_CORNERS, CS_SQL, processed, sql
from trackside.plans.registry import register
from trackside.plans.sqlfrag import KEYS, xmean
from trackside.sources import api_docs, files, sinks, store
from trackside.sources.adapter import read_table, telemetry_view


@register("landed_documents", """
v AS (SELECT event_id, user_id, value, epoch_us(ts) AS us, user_id % 25 = 7 AS cut, event_id % 40 = 3 AS odd FROM events WHERE event_type = 'view')
---
SELECT CAST(user_id AS INTEGER) AS driver_number, 'stored' AS kind, count(*) AS n, round(sum(value), 6) AS total, min(us) AS first_us
FROM v WHERE NOT cut AND NOT odd GROUP BY user_id
UNION ALL
SELECT NULL, 'row', count(*), NULL, NULL FROM v WHERE NOT cut AND odd
UNION ALL
SELECT NULL, 'document', count(DISTINCT user_id), NULL, NULL FROM v WHERE cut""", adapter=False)
def q_landed_documents(spark, sf):
    """SRC-4 + SC-13: array documents are landed as JSON lines, some cut short, some with a value of a
    wrong type; what is read back and what is rejected adds up."""
    ev = read_table(spark, sf, "events").filter("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp"))
    row = F.to_json(F.struct(
        F.pmod("user_id", F.lit(4)).cast("long").alias("session_key"), F.col("user_id").alias("driver_number"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("date"), F.col("value").alias("speed")))
    odd = F.when(F.col("event_id") % 40 == 3, F.regexp_replace(row, '"driver_number":', '"driver_number":"car ",'
                                                                                     '"extra":')).otherwise(row)
    docs = ev.withColumn("j", odd).groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("d"))
    docs = docs.select(F.when(F.col("user_id") % 25 == 7, F.expr("left(d, length(d) - 9)")).otherwise(F.col("d")).alias("d"))
    root = _shared(spark, "landed")
    docs.write.text(f"{root}/dump")
    bad = api_docs.land_documents(spark, f"{root}/dump", root, "car_data", whole_files=False)
    rows, broken = api_docs.read_documents(spark, root, "car_data")
    good = rows.groupBy("driver_number").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("speed")).alias("total"),
                                             F.min(F.unix_micros("date")).alias("first_us"))
    rejects = bad.unionByName(broken).groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    cols = ["driver_number", "kind", "n", "total", "first_us"]
    return good.withColumn("kind", F.lit("stored")).select(*cols).unionByName(
        rejects.withColumns({"driver_number": F.lit(None).cast("int"), "total": F.lit(None).cast("double"),
                             "first_us": F.lit(None).cast("long")}).select(*cols))


@register("processed_files", """
SELECT sample_id, "TimeInLap", CAST(2024 + "Round" % 2 AS INTEGER) AS "Year", "Round", 'event' || "Round" AS event_slug, "Round" = 3 AS is_sample
FROM tel WHERE "Driver" <> '3' AND ("Round" <> 3 OR sample_id % 2 = 0)""")
def q_processed_files(spark, sf):
    """SRC-2 + SC-10: one CSV file per session; rounds 0 to 2 also have a sample file that must not be read."""
    tel = telemetry_view(spark, sf).filter("Driver <> '3'").select("sample_id", "TimeInLap", "Round")
    root = _shared(spark, "processed")
    for r in range(4):  # the four rounds of the adapter
        own = tel.filter(F.col("Round") == r).select("sample_id", "TimeInLap")
        name = f"{root}/r{r:02d}_event{r}_{2024 + r % 2}_quali_telemetry_processed"
        sinks.write_csv(own.filter("sample_id % 2 = 0"), f"{name}_sample.csv")
        if r < 3:
            sinks.write_csv(own, f"{name}.csv.gz" if r == 1 else f"{name}.csv", compress=r == 1)
    return files.read_processed_sessions(spark, root, "sample_id long, TimeInLap double")


@register("schedule_file", """
SELECT CAST(n_nationkey AS INTEGER) AS "RoundNumber", n_name AS "Country" FROM nation""", adapter=False)
def q_schedule_file(spark, sf):
    """SRC-3: a schedule written with an index column is read without it."""
    path = _shared(spark, "schedule")
    table = read_table(spark, sf, "nation").select((F.col("n_nationkey") * 2).alias("Unnamed: 0"), F.col("n_nationkey").alias("RoundNumber"),
                                                   F.col("n_name").alias("Country"))
    sinks.write_csv(table, f"{path}/schedule.csv.gz", compress=True)
    read = files.read_schedule(spark, f"{path}/schedule.csv")
    return read.select(*[F.col(c).cast("int") if c == "RoundNumber" else F.col(c) for c in read.columns])


@register("load_fallback", sql("""
SELECT sample_id, round("Acceleration", 6) AS "Acceleration", 'raw' AS "Source" FROM acc WHERE "Round" = 1
UNION ALL
SELECT sample_id, 1.0, 'processed' FROM acc WHERE "Round" = 2"""))
def q_load_fallback(spark, sf):
    """SRC-7: round 2 has a processed table, round 1 only a raw one, which is processed on reading."""
    tel, root = telemetry_view(spark, sf), _shared(spark, "load")
    tel.filter("Round = 1").write.parquet(f"{root}/raw1")
    tel.filter("Round = 2").withColumn("Acceleration", F.lit(1.0)).write.parquet(f"{root}/processed2")
    cols = ["sample_id", "Acceleration"]
    raw = files.load_telemetry(spark, f"{root}/processed1", f"{root}/raw1", corners=ADAPTER_CORNERS).select(*cols)
    done = files.load_telemetry(spark, f"{root}/processed2", f"{root}/raw2").select(*cols)
    return round6(raw, ["Acceleration"]).withColumn("Source", F.lit("raw")).unionByName(done.withColumn("Source", F.lit("processed")))


@register("session_previews", f"""
SELECT "Round", sample_id FROM (SELECT "Round", sample_id, row_number() OVER (
  PARTITION BY {KEYS} ORDER BY "DriverNumber", "LapNumber", "TimeInLap" NULLS LAST, sample_id) AS i FROM tel) WHERE i <= 99""")
def q_session_previews(spark, sf):
    """SNK-2: the first 99 rows (100 lines) of every session, written as one CSV folder a session and read back."""
    path = _shared(spark, "previews")
    tel = telemetry_view(spark, sf).select(*S.SESSION_KEYS, "DriverNumber", "LapNumber", "TimeInLap", "sample_id")
    sinks.write_previews(tel, path, n_lines=100)
    read = spark.read.option("header", True).csv(path)
    return read.select(F.col("Round").cast("int").alias("Round"), F.col("sample_id").cast("long").alias("sample_id"))


@register("published_run", """
SELECT 'first' AS "Seen", c_mktsegment AS "Segment", count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'second', c_mktsegment, count(*) FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL""", adapter=False)
def q_published_run(spark, sf):
    """SNK-5: readers see a run's tables only when all are written; an unfinished run leaves the one before."""
    path, customer = _shared(spark, "runs"), read_table(spark, sf, "customer")
    def tables(df):
        return {"segments": df.groupBy(F.col("c_mktsegment").alias("Segment")).agg(F.count(F.lit(1)).alias("n")), "all": df}
    store.publish_run(spark, path, tables(customer), {"rows": "all"})
    for name, df in tables(customer.filter("c_custkey < 0")).items():  # a run that never gets its manifest row
        df.write.parquet(f"{path}/run={uuid.uuid4().hex}/{name}")
    first = store.read_run(spark, path, "segments").withColumn("Seen", F.lit("first"))
    store.publish_run(spark, path, tables(customer.filter("c_custkey % 2 = 0")), {"rows": "even"})
    return first.unionByName(store.read_run(spark, path, "segments").withColumn("Seen", F.lit("second")))


@register("clustered_acceleration", sql("""
SELECT sample_id, round("Acceleration", 6) AS "Acceleration" FROM acc"""))
def q_clustered_acceleration(spark, sf):
    """SNK-1/3: the samples as a table bucketed and sorted by lap; acceleration shuffles nothing."""
    table = store.write_clustered(telemetry_view(spark, sf), _shared(spark, "clustered"), f"laps_{uuid.uuid4().hex}", buckets=8)
    return round6(kinematics.add_acceleration(table), ["Acceleration"]).select("sample_id", "Acceleration")


def _season(spark, sf):
    """The adapter's rounds added one by one, the last one in two parts."""
    path = _shared(spark, "season-matrix")
    rows = features_table(spark, sf)
    for r in range(4):
        own = rows.filter(F.col("Round") == r)
        if r == 3:
            season_matrix.add_sessions(spark, own.filter(F.length("Driver") == 1), path)
        season_matrix.add_sessions(spark, own.filter(F.length("Driver") > 1) if r == 3 else own, path)
    return path


def features_table(spark, sf):
    from trackside.session import cut_lineage
    return cut_lineage(rdf(spark, sf))


@register("season_matrix_incremental", ACC_SQL + "," + ZSCORE_SQL + f"""
---
SELECT "Driver", {", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in FEATS)} FROM zr GROUP BY "Driver\"""")
def q_season_matrix_incremental(spark, sf):
    """PL-5/PL-6: sessions are added one by one; the matrix equals that of all sessions at once."""
    return round6(season_matrix.season_matrix(spark, _season(spark, sf)), FEATS)


@register("display_orders", sql("""
SELECT 'corners' AS "Kind", "Corner" AS "Key", "Driver", CAST(row_number() OVER (ORDER BY "Corner", "Min_Speed", "Driver") AS BIGINT) AS "Place"
FROM cs WHERE "Round" = 1""", CS_SQL))
def q_display_orders(spark, sf):
    """TK-1: the corner table of one session in display order; the place is the row's position."""
    table = summaries.corner_summary(processed(spark, sf)).filter("Round = 1").drop("Year", "Round", "SessionType")
    shown = charts.display_sorted(table, "corners").coalesce(1).withColumn("Place", F.monotonically_increasing_id() + 1)
    return shown.select(F.lit("corners").alias("Kind"), F.col("Corner").alias("Key"), "Driver", "Place")


@register("empty_inputs", """
SELECT * FROM (VALUES ('acceleration', 0::BIGINT, true), ('classification', 0, true), ('corner_summary', 0, true),
  ('driver_summary', 0, true), ('features', 0, true)) t("Operator", "Rows", "Same_Columns")""", adapter=False)
def q_empty_inputs(spark, sf):
    """FLT-9: operators on an empty part of the table give empty frames with the columns of a full one."""
    from trackside.session import cut_lineage
    tel = processed(spark, sf)
    none = cut_lineage(tel.filter("sample_id < 0"))
    def outputs(df):
        return {"acceleration": kinematics.add_acceleration(df.drop("Acceleration", "Accel_Type", "Speed_ms")),
                "classification": laps.classification(df), "corner_summary": summaries.corner_summary(df),
                "driver_summary": summaries.driver_summary(df), "features": features.round_driver_features(df)}
    full = {k: v.columns for k, v in outputs(cut_lineage(tel.filter("Round = 1 AND Driver < '2'"))).items()}
    out = None
    for name, df in outputs(none).items():
        one = df.agg(F.count(F.lit(1)).alias("Rows")).select(
            F.lit(name).alias("Operator"), "Rows", F.lit(df.columns == full[name]).alias("Same_Columns"))
        out = one if out is None else out.unionByName(one)
    return out


@register("cluster_guard", """
SELECT label AS "Label", count(*) AS "Rows", count(*) < 3 AS "Refused" FROM (
  SELECT vec_id, CASE WHEN vec_id < 2 THEN -1 WHEN vec_id < 5 THEN -2 ELSE label END AS label FROM embeddings) GROUP BY ALL
HAVING label < 0""", adapter=False)
def q_cluster_guard(spark, sf):
    """ML-9: groups of two and three embeddings; a fit needs three rows."""
    from trackside.plans.q_ml import DIMS, emb_matrix
    m = emb_matrix(spark, sf).withColumn("_id", F.col("Driver").cast("long"))
    out = None
    for label, cond in ((-1, "_id < 2"), (-2, "_id >= 2 AND _id < 5")):
        own = m.filter(cond).drop("_id", "Cluster")
        try:
            clustering.fit_driver_clusters(own, n_clusters=2, n_init=1, cols=DIMS[:4], score=False, pca=False)
            refused = False
        except ValueError:
            refused = True
        one = own.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(label).alias("Label"), "Rows", F.lit(refused).alias("Refused"))
        out = one if out is None else out.unionByName(one)
    return out


@register("weakest_corner_leaders", sql(f"""
SELECT {KEYS}, "Corner", 'Deceleration' AS "Board", "Rank", "Driver", "Max_Deceleration" AS "Value" FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS}, "Corner" ORDER BY "Max_Deceleration" DESC, "Driver") AS INTEGER) AS "Rank"
  FROM cs WHERE "Max_Deceleration" IS NOT NULL) WHERE "Rank" <= 10""", CS_SQL))
def q_weakest_corner_leaders(spark, sf):
    """TK-4 as the analysed notebook has it: the ten weakest decelerations of each corner."""
    return summaries.corner_leaders(processed(spark, sf), reference_tail=True).filter("Board = 'Deceleration'")


@register("driver_summary_display", f"""
SELECT {KEYS}, "Driver", round_even({xmean('"Speed"')}, 1) AS "Avg_Speed", round_even(max("Speed"), 1) AS "Max_Speed",
       round_even({xmean('"Throttle"')}, 1) AS "Avg_Throttle", round_even({xmean('CAST("Brake" AS INTEGER)')} * 100.0, 1) AS "Brake_Pct",
       round_even({xmean('"RPM"')}, 1) AS "Avg_RPM", round_even(max("RPM"), 1) AS "Max_RPM",
       count(DISTINCT "LapNumber") AS "Laps", count(*) AS "Data_Points"
FROM tel GROUP BY ALL""")
def q_driver_summary_display(spark, sf):
    """AG-4 as users call it: rounded half-even to one digit."""
    return summaries.driver_summary(telemetry_view(spark, sf), exact_mean=True)
