"""The session store with a commit manifest (SNK-1, SNK-3, SNK-5, SNK-8, SNK-9) and its lap-clustered form.

Every commit writes its sessions into a folder of its own, ``data/version=<id>``, and then one
manifest row per session (a small Parquet file, written last). Readers take each
session's newest version from the manifest, so a write that ends half way leaves the
old version in place and its sessions count as unwritten; nothing is overwritten.
Published runs (the five tables of a clustering run) work the same way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S
from trackside.sources.files import path_exists
from trackside.sources.sinks import STORE_PARTITIONS

MANIFEST = "Year int, Round int, SessionType string, version string, commit_no long, rows long, columns string"
LAP_CLUSTER = [*S.SESSION_KEYS, "DriverNumber", S.LAP_COL]


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """All manifest rows (one per session and commit)."""
    path = f"{store.rstrip('/')}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], MANIFEST)


def live_sessions(spark: SparkSession, store: str) -> DataFrame:
    """Each session's newest committed version: the session keys, version, rows."""
    newest = F.max(F.struct("commit_no", "version", "rows")).alias("m")
    return (manifest(spark, store).groupBy(*STORE_PARTITIONS).agg(newest)
            .select(*STORE_PARTITIONS, "m.version", "m.rows"))


def write_version(df: DataFrame, store: str, *, max_records_per_file: int = 5_000_000) -> str:
    """The data of a commit, which no reader sees before ``commit_version``."""
    version = uuid.uuid4().hex
    (df.sortWithinPartitions(*STORE_PARTITIONS).write.option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*STORE_PARTITIONS).parquet(f"{store.rstrip('/')}/data/version={version}"))
    return version


def commit_version(spark: SparkSession, store: str, version: str, schema: T.StructType) -> DataFrame:
    """Publish a written version: one manifest row per session that it holds."""
    # all columns, the session keys among them; with the schema given, no key is read as another type
    found = _versions(spark, store, schema, [version])
    number = (manifest(spark, store).agg(F.max("commit_no")).first()[0] or 0) + 1
    rows = (found.groupBy(*STORE_PARTITIONS).agg(F.count(F.lit(1)).alias("rows"))
            .select(*STORE_PARTITIONS, F.lit(version).alias("version"), F.lit(number).cast("long").alias("commit_no"), "rows",
                    F.lit(schema.json()).alias("columns")))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], MANIFEST).schema])
    rows.coalesce(1).write.mode("append").parquet(f"{store.rstrip('/')}/manifest")
    return rows


def commit_sessions(df: DataFrame, store: str, **kw) -> str:
    """Write and publish the sessions of ``df``; a session that is there already gets a new version."""
    version = write_version(df, store, **kw)
    commit_version(df.sparkSession, store, version, df.schema)
    return version


def _versions(spark: SparkSession, store: str, schema: T.StructType, versions: list[str]) -> DataFrame:
    base = f"{store.rstrip('/')}/data"
    full = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
    paths = [p for p in (f"{base}/version={v}" for v in versions) if path_exists(spark, p)]
    return spark.read.schema(full).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], full)


def stored_schema(spark: SparkSession, store: str) -> T.StructType:
    """The columns of all commits; of columns with one name, the newest commit's."""
    seen: dict[str, T.StructField] = {}
    for r in manifest(spark, store).groupBy("columns").agg(F.max("commit_no").alias("n")).orderBy(F.col("n").desc()).collect():
        for f in T.StructType.fromJson(json.loads(r["columns"])).fields:
            seen.setdefault(f.name, f)
    return T.StructType([f for f in seen.values()])


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The store as committed: every session once, in its newest version.

    The manifest is small (sessions x commits); it picks the folders, and a semi join on
    the partition columns drops sessions that a later version replaced."""
    schema = stored_schema(spark, store)
    if not schema.fields:
        raise FileNotFoundError(f"nothing committed in {store}")
    live = live_sessions(spark, store)
    versions = [r["version"] for r in live.select("version").distinct().collect()]
    df = _versions(spark, store, schema, versions)
    on = [df[k].eqNullSafe(live[k]) for k in [*STORE_PARTITIONS, "version"]]
    return df.join(F.broadcast(live), on, "left_semi").drop("version")


def missing_sessions(spark: SparkSession, expected: DataFrame, store: str) -> DataFrame:
    """SNK-8: expected sessions without a committed version (null keys are keys)."""
    live = live_sessions(spark, store)
    return expected.join(live, [expected[k].eqNullSafe(live[k]) for k in STORE_PARTITIONS], "left_anti")


def ingest_status(spark: SparkSession, expected: DataFrame, store: str,
                  session_types: tuple[str, ...] = ("Q", "R")) -> DataFrame:
    """SNK-9: per round whether each session type is committed, the number of committed sessions and their rows."""
    live = live_sessions(spark, store).select(*[F.col(k).alias(f"_{k}") for k in STORE_PARTITIONS], F.col("rows").alias("_rows"))
    j = expected.select(*STORE_PARTITIONS).distinct().join(
        live, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in STORE_PARTITIONS], "left")
    return j.groupBy("Year", "Round").agg(*[
        F.coalesce(F.max((F.col("SessionType") == t) & F.col("_rows").isNotNull()), F.lit(False)).alias(f"{t.lower()}_ok")
        for t in session_types], F.count("_rows").alias("processed_sessions"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("stored_rows"))


RUNS = "run string, run_no long, tables array<string>, summary string"


def publish_run(spark: SparkSession, path: str, tables: dict[str, DataFrame], summary: dict, save=None) -> str:
    """SNK-5, SNK-6: the tables of a run in a folder of its own, then one manifest row with the summary.

    ``save(folder)`` may write more into the folder (a model) before the run is published."""
    run = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/run={run}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    if save is not None:
        save(folder)
    number = (_runs(spark, path).agg(F.max("run_no")).first()[0] or 0) + 1
    row = spark.createDataFrame([(run, number, sorted(tables), json.dumps(summary))], RUNS)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/runs")
    return run


def _runs(spark: SparkSession, path: str) -> DataFrame:
    where = f"{path.rstrip('/')}/runs"
    return spark.read.schema(RUNS).parquet(where) if path_exists(spark, where) else spark.createDataFrame([], RUNS)


def latest_run(spark: SparkSession, path: str):
    """The newest published run (run, tables, summary as a dict, folder), or None."""
    r = _runs(spark, path).orderBy(F.col("run_no").desc(), F.col("run").desc()).first()
    return None if r is None else {"run": r.run, "tables": r.tables, "summary": json.loads(r.summary),
                                   "folder": f"{path.rstrip('/')}/run={r.run}"}


def read_run(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the newest published run."""
    found = latest_run(spark, path)
    if found is None or table not in found["tables"]:
        raise FileNotFoundError(f"{path}: no published run with {table}")
    return spark.read.parquet(f"{found['folder']}/{table}")


def _quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write_clustered(df: DataFrame, path: str, table: str, *, buckets: int, cluster: list[str] = LAP_CLUSTER,
                    sort: list[str] | None = None) -> DataFrame:
    """SNK-1/3 clustered by lap: a bucketed, sorted table, so that lap operators read a lap's
    samples from one bucket and shuffle nothing. Returns the table, read through the catalogue.

    One shuffle at the write (by the same keys) puts each bucket into one file."""
    sort = sort or [S.TIME_COL, *([S.SAMPLE_ID] if S.SAMPLE_ID in df.columns else [])]
    (df.repartition(buckets, *cluster).write.format("parquet").bucketBy(buckets, *cluster).sortBy(*sort)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def open_clustered(spark: SparkSession, path: str, table: str, schema: T.StructType, *, buckets: int,
                   cluster: list[str] = LAP_CLUSTER, sort: list[str] | None = None) -> DataFrame:
    """Make a clustered table that another session wrote known to this session's catalogue, and read it."""
    sort = sort or [S.TIME_COL, *([S.SAMPLE_ID] if S.SAMPLE_ID in schema.names else [])]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({_quoted(cluster)}) "
              f"SORTED BY ({_quoted(sort)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)
