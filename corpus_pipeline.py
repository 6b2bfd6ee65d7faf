"""From raw documents to a training mix: five stages, each one operator of ``trackside.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and reads it back as the next
stage's input, so a lost executor never costs more than one stage. All stages but
the last return the columns of ``documents``; the last adds rate, n_copies,
copy_no and shuffle_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackside.llm import decontaminate, exact_dedup, langid, queries, simhash
from trackside.llm.common import read_table, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no letters, or ambiguous in spite of enough of them."""
    return langid.keep_identified(docs, queries.language_model(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    return simhash.simhash_dedup(docs, shingle_words=3, max_bits=3)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's target rate, in a global random order."""
    return queries.mixed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("decontamination", clean), ("mixing", mix)]

# Language ID and SimHash have no SQL form; tests/llm/test_pipeline.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
