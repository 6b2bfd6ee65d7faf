"""Incremental ingest with Structured Streaming (SNK-8 re-aimed).

The file source remembers which landed files it has processed (in the query
checkpoint), so ``trigger(availableNow=True)`` processes only new sessions and
re-running writes nothing. A micro-batch adds its (session, file) pairs to an index of
landed files; the sessions it touches are computed anew (PL-1) from all their
files, which the index names, and committed to the store (``sources.store``). So a
session may arrive in any number of files, batches and runs, and no batch reads
the files of other sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S
from trackside.operators.kinematics import process_telemetry
from trackside.sources.sinks import STORE_PARTITIONS
from trackside.sources.store import commit_sessions

INDEX = "Year int, Round int, SessionType string, file string, batch long"


def file_index(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, file) pairs of everything that the ingest has seen."""
    return spark.read.schema(INDEX).parquet(f"{checkpoint.rstrip('/')}/file-index")


def files_of(index: DataFrame, touched: DataFrame) -> DataFrame:
    """The landed files that hold rows of the touched sessions."""
    on = [index[k].eqNullSafe(touched[k]) for k in STORE_PARTITIONS]
    return index.join(touched, on, "left_semi").select("file").distinct()


def start_ingest(spark: SparkSession, landed_dir: str, store: str, checkpoint: str, *,
                 schema: T.StructType = S.TELEMETRY_SCHEMA, fmt: str = "parquet",
                 corners: dict | None = None, max_files_per_trigger: int | None = None):
    """Start the ingest query (``availableNow``); returns the StreamingQuery."""
    header = {"header": "true"} if fmt == "csv" else {}
    reader = spark.readStream.schema(schema).format(fmt).options(**header)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landed_dir).select(*STORE_PARTITIONS, F.col("_metadata.file_path").alias("file"))

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # a repeated batch replaces its own part of the index
        part = f"{checkpoint.rstrip('/')}/file-index/batch={batch_id}"
        batch.select(*[F.col(k).cast(t) for k, t in zip(STORE_PARTITIONS, ("int", "int", "string"))], "file").distinct() \
            .coalesce(1).write.mode("overwrite").parquet(part)
        index = file_index(session, checkpoint)
        touched = index.filter(F.col("batch") == batch_id).select(*STORE_PARTITIONS).distinct()
        paths = [r.file for r in files_of(index, touched).collect()]  # names of the touched sessions' files
        if not paths:
            return
        landed = session.read.schema(schema).format(fmt).options(**header).load(paths)
        on = [landed[k].eqNullSafe(touched[k]) for k in STORE_PARTITIONS]
        commit_sessions(process_telemetry(landed.join(touched, on, "left_semi"), corners=corners), store)

    return (stream.writeStream.foreachBatch(each_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
