"""File sources (SRC-1, SRC-2, SRC-3, SRC-6, SRC-7).

Storage paths may be any Hadoop-compatible URI; existence checks go through the
session's Hadoop FileSystem, so they work on cluster storage as well.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S

# Processed-session file names: r{NN}_{slug}_{year}_quali_telemetry_processed
# with variants .csv (priority 0), .csv.gz (1) and _sample.csv (2).
PROCESSED_NAME = r"r(\d+)_(.+)_(\d{4})_quali_telemetry_processed(\.csv\.gz|\.csv|_sample\.csv)$"
VARIANT_PRIORITY = {".csv": 0, ".csv.gz": 1, "_sample.csv": 2}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, from the file system's listing (no file is opened)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(x.getPath().toString() for x in (found or []))


def resolve_data_path(spark: SparkSession, path: str) -> str | None:
    """SRC-1: the path itself, else ``path + '.gz'``, else None."""
    if path_exists(spark, path):
        return path
    if path_exists(spark, path + ".gz"):
        return path + ".gz"
    return None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """SRC-1: header CSV (gzip decoded by extension), with the ``.gz`` fallback.

    A gzip file is one task (not splittable); land big inputs as Parquet."""
    resolved = resolve_data_path(spark, path)
    if resolved is None:
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(resolved)


def choose_variants(paths: list[str]) -> list[str]:
    """SC-10 / SRC-2: per (year, round) and event the best file variant (csv > csv.gz > _sample.csv)."""
    best: dict[tuple, tuple[int, str]] = {}
    for path in paths:
        m = re.search(PROCESSED_NAME, path.rsplit("/", 1)[-1])
        if m:
            key = (m[3], int(m[1]), m[2])
            best[key] = min(best.get(key, (99, "")), (VARIANT_PRIORITY[m[4]], path))
    return [path for _, path in best.values()]


def read_processed_sessions(spark: SparkSession, directory: str, schema: T.StructType | str) -> DataFrame:
    """SRC-2: every processed session file of ``directory``; per year, round and event
    only the best variant (csv > csv.gz > _sample.csv) is read. Adds ``Year``, ``Round``
    (from the name where absent or null), ``event_slug`` and ``is_sample``.

    The variants are chosen from the directory listing, so only the chosen files are scanned."""
    chosen = choose_variants(list_paths(spark, f"{directory.rstrip('/')}/r*_quali_telemetry_processed*"))
    # the chosen name is a file, or a folder of part files
    name = F.regexp_extract(F.col("_metadata.file_path"), "/(" + PROCESSED_NAME[:-1].replace("(.+)", "([^/]+)") + ")(/[^/]+)?$", 1)

    def part(i):
        return F.regexp_extract(name, PROCESSED_NAME, i)

    raw = (spark.read.option("header", True).schema(schema).csv(chosen) if chosen
           else spark.createDataFrame([], schema))
    named = {"Year": part(3).try_cast("int"), "Round": part(1).try_cast("int"), "event_slug": part(2),
             "is_sample": part(4) == "_sample.csv"}
    if not chosen:
        named = {"Year": F.lit(None).cast("int"), "Round": F.lit(None).cast("int"), "event_slug": F.lit(None).cast("string"),
                 "is_sample": F.lit(None).cast("boolean")}
    own = {c: F.coalesce(F.col(c).cast("int"), v) if c in raw.columns and c in ("Year", "Round") else v
           for c, v in named.items()}
    return raw.select(*[c for c in raw.columns if c not in own], *[v.alias(c) for c, v in own.items()])


SCHEDULE_DROP = ("Unnamed: 0", "_c0")


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: season schedule CSV; the written index column is dropped."""
    df = read_csv(spark, path)
    return df.drop(*[c for c in SCHEDULE_DROP if c in df.columns])


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  **options) -> DataFrame:
    """SRC-6: a stored result table, or an empty frame of ``schema`` when missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_table_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A stored table by its name: CSV (with the ``.gz`` fallback of SRC-1) or Parquet; None when missing."""
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema) if resolve_data_path(spark, path) else None
    return spark.read.parquet(path) if path_exists(spark, path) else None


def load_telemetry(spark: SparkSession, processed: str, raw: str | None = None, corners: dict | None = None,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """SRC-7: processed telemetry if present, else the raw table processed by PL-1.
    Either may be Parquet, ``.csv`` or ``.csv.gz``."""
    from trackside.operators.kinematics import process_telemetry
    found = read_table_file(spark, processed, schema)
    if found is not None:
        return found
    landed = read_table_file(spark, raw, schema) if raw is not None else None
    if landed is not None:
        return process_telemetry(landed, corners=corners)
    raise FileNotFoundError(processed)


def canonical_order(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """PRJ-1: canonical column order, keeping only present columns (+ extras)."""
    cols = [c for c in S.CANONICAL_COLUMNS if c in df.columns]
    rest = [c for c in (extra or []) if c in df.columns and c not in cols]
    return df.select(*cols, *rest)
