"""Sinks (SNK-1..9): the partitioned Parquet store, CSV export, previews,
summaries, incremental writes and the ingest manifest."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators.common import sample_sort_cols, top_n
from trackside.sources.files import list_paths

STORE_PARTITIONS = ["Year", "Round", "SessionType"]


def write_store(df: DataFrame, path: str, *, partition_by: list[str] = STORE_PARTITIONS,
                mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """SNK-1/SNK-3: the telemetry store, partitioned by session; with
    ``mode='overwrite'`` only the partitions present in ``df`` are replaced
    (dynamic partition overwrite), so re-running one session is idempotent.

    No shuffle by the partition columns (a large session would land in one
    task): every task writes its own rows, sorted by partition so each task
    keeps one open file, and files are capped at ``max_records_per_file``."""
    (df.sortWithinPartitions(*partition_by)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*partition_by).parquet(path))


def write_csv(df: DataFrame, path: str, *, compress: bool = False, mode: str = "overwrite") -> None:
    """SNK-1 CSV export (gzip when ``compress``)."""
    w = df.write.mode(mode).option("header", True)
    if compress:
        w = w.option("compression", "gzip")
    w.csv(path)


def preview(df: DataFrame, *, n_lines: int = S.PREVIEW_LINES, order: list | None = None) -> DataFrame:
    """SNK-2: the first ``n_lines - 1`` rows (the header is a line) in an explicit
    order (session keys, driver, lap, time); a top-k, not a full sort."""
    order = order or [*[c for c in [*S.SESSION_KEYS, "DriverNumber", S.LAP_COL] if c in df.columns],
                       *sample_sort_cols(df)]
    return df.orderBy(*order).limit(max(n_lines - 1, 0))


def previews(df: DataFrame, *, by: list[str] = STORE_PARTITIONS, n_lines: int = S.PREVIEW_LINES) -> DataFrame:
    """SNK-2 for every session (or other key) at once: the first ``n_lines - 1`` rows of each, by a
    two-phase top-n; no session is sorted in one task."""
    rank = "_line"
    # a total order: rows that tie in it are alike in every column that can be compared
    ties = [F.col(f.name).asc() for f in df.schema.fields
            if f.name not in by and f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    order = [*[F.col(c).asc() for c in ("DriverNumber", S.LAP_COL) if c in df.columns], *sample_sort_cols(df), *ties]
    return top_n(df, list(by), order, max(n_lines - 1, 0), rank_col=rank, salt_by=[
        f.name for f in df.schema.fields if f.dataType.typeName() != "map"]).drop(rank)


def write_previews(df: DataFrame, path: str, *, by: list[str] = STORE_PARTITIONS, n_lines: int = S.PREVIEW_LINES) -> None:
    """SNK-2: one CSV preview folder per session; sessions that are not in ``df`` keep theirs."""
    (previews(df, by=by, n_lines=n_lines).repartition(*by).write.mode("overwrite").option("header", True)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).csv(path))


def write_preview(df: DataFrame, path: str, **kw) -> None:
    """SNK-2: preview as one CSV file (bounded by ``n_lines``)."""
    write_csv(preview(df, **kw).coalesce(1), path)


def publish_summary(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """SNK-4: overwrite a summary table; an empty input is skipped (False)."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").format(fmt).save(path)
    return True


def write_run_summary(spark: SparkSession, path: str, **fields) -> None:
    """SNK-6: one-row JSON summary (e.g. n_rounds, n_drivers, n_clusters, silhouette)."""
    spark.createDataFrame([(json.dumps(fields),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def written_sessions(spark: SparkSession, store: str, keys: list[str] = STORE_PARTITIONS) -> DataFrame:
    """Sessions already present in the store, from the listing of its partition folders
    (no stored row is read)."""
    found = list_paths(spark, f"{store.rstrip('/')}/" + "/".join(f"{k}=*" for k in STORE_PARTITIONS))
    rows = []
    for path in found:
        values = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)
                  for k, v in (x.split("=", 1) for x in path.rsplit("/", len(STORE_PARTITIONS))[1:])}
        rows.append((*[None if values[k] is None else int(values[k]) for k in ("Year", "Round")], values["SessionType"]))
    return spark.createDataFrame(rows, "Year int, Round int, SessionType string").select(*keys)


def sessions_to_process(spark: SparkSession, sessions: DataFrame, store: str,
                        keys: list[str] = STORE_PARTITIONS) -> DataFrame:
    """SNK-8: expected sessions not yet written (left anti join)."""
    return sessions.join(written_sessions(spark, store, keys), keys, "left_anti")


def ingest_manifest(spark: SparkSession, expected: DataFrame, store: str,
                    session_types: tuple[str, ...] = ("Q", "R")) -> DataFrame:
    """SNK-9: per round, whether each session type is in the store, plus the
    number of processed sessions."""
    have = written_sessions(spark, store).withColumn("_ok", F.lit(True))
    j = expected.join(have, ["Year", "Round", "SessionType"], "left")
    out = j.groupBy("Year", "Round").agg(*[
        F.coalesce(F.max(F.when(F.col("SessionType") == t, F.col("_ok"))), F.lit(False)).alias(f"{t.lower()}_ok")
        for t in session_types], F.count("_ok").alias("processed_sessions"))
    return out
