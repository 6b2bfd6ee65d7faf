"""Helpers shared by the training-data operators: tables, shared storage, crc folds."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Word separators of every contract that says [^\x20\x09-\x0D]+; these are also
# the bytes at which ``bytes.split()`` splits.
SPACE_BYTES = b"\x09\x0a\x0b\x0c\x0d\x20"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder (never reused, so a retry cannot mix runs)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows reads committed files, so a lost executor
    costs only its running tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches by bytes too, for tables of whole texts written inside: 10,000 rows have no bound in bytes."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
        else:
            spark.conf.set(BATCH_CONF, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII values take the fast built-in ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_row(columns: list[str]) -> Column:
    """Aggregate: the row (as a struct) whose columns sort first as JSON text; columns of any type."""
    row = F.struct(*columns)
    return F.min_by(row, F.to_json(row))
