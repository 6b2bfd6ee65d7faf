"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.session import cut_lineage


def sample_order(df: DataFrame, time_col: str = S.TIME_COL) -> Column:
    """Total order of samples inside a lap: TimeInLap (nulls last, T17), then tie-breaks."""
    parts = [F.col(time_col).isNull(), F.col(time_col)]
    if S.SAMPLE_ID in df.columns:
        parts.append(F.col(S.SAMPLE_ID))
    return F.struct(*parts)


def sample_sort_cols(df: DataFrame, time_col: str = S.TIME_COL) -> list[Column]:
    cols = [F.col(time_col).asc_nulls_last()]
    if S.SAMPLE_ID in df.columns:
        cols.append(F.col(S.SAMPLE_ID).asc())
    return cols


def first_non_null(value: str | Column, order: Column) -> Column:
    """pandas ``first``: the first non-null value in sample order (T4)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.when(v.isNotNull(), order))


def present(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def drop_null_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """pandas groupby drops null keys (T3)."""
    cond = None
    for c in cols:
        e = F.col(c).isNotNull()
        cond = e if cond is None else cond & e
    return df if cond is None else df.filter(cond)


def mean(c, exact: bool = False) -> Column:
    """Mean of non-null values.

    ``exact=True`` sums in ``decimal(38,18)`` (exact for telemetry magnitudes), so
    the result is the same whatever the partitioning and summation order; the
    default is Spark's double ``avg``.
    """
    col = F.col(c) if isinstance(c, str) else c
    if not exact:
        return F.avg(col)
    return F.sum(col.cast("decimal(38,18)")).cast("double") / F.count(col).cast("double")


def with_group_stats(df: DataFrame, group: list[str], stats: list[Column]) -> DataFrame:
    """``df`` with aggregates of each group, as a partial aggregate joined back (a group's
    rows never meet in one task). ``df`` is materialised, so its plan runs once."""
    df = cut_lineage(df)
    found = df.groupBy(*group).agg(*stats)
    return df.join(found, list(group))


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``row_number`` per group under a total ``order`` without a window over a whole group.

    Rows are range-partitioned by (group, order) and written once; each slice numbers
    its own rows and adds the row count of the group's earlier slices, taken from a table
    with one row per group and slice."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.repartitionByRange(slices, *[F.col(g) for g in group], *order)
                       .withColumn("_slice", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
             .select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = rows.withColumn("_own", F.row_number().over(own))
    return (numbered.join(sizes, [*group, "_slice"])
            .withColumn(out, (F.col("_own") + F.col("_before")).cast("int")).drop("_slice", "_own", "_before"))


def rank_by_bucket(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``row_number`` per group under a total ``order`` that begins with the order of ``bucket`` (a rounded
    value): rows are numbered inside (group, bucket) and the counts of the group's lower buckets are
    added, so neither a sort by range nor a window over a whole group is needed."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_gb"),
                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_bucket").eqNullSafe(F.col("_gb"))]
    return own.join(sizes, on).select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias(out))


LAP_TASK_ROWS = 1 << 16


def dealt_by_lap(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """``df`` partitioned by the lap ``keys`` into tasks of about ``LAP_TASK_ROWS`` rows, however many rows there
    are; windows and aggregates on the keys use this exchange. A given number of partitions is not
    coalesced again, so the sorts of one task stay as small as its rows. ``rows`` spares a count (one
    job, from the footers where ``df`` is a Parquet table); a table of one task is left as it is. Name no
    constant among ``keys``: windows would then not use the exchange."""
    rows = df.count() if rows is None else rows
    if rows <= LAP_TASK_ROWS:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, -(-rows // LAP_TASK_ROWS)), *keys)


TOP_N_SALTS = 64


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, *, rank_col: str = "Rank",
          salt_by: list[str] | None = None, salts: int = TOP_N_SALTS) -> DataFrame:
    """Top ``n`` rows per group under a total ``order``, ranked 1..n, in two phases:
    the top n per (group, salt) first (a hot group is split over ``salts``
    partitions), then the top n of those candidates (at most n x salts rows per
    group). Equal to a single ``row_number`` window when ``order`` is total."""
    cols = salt_by or df.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts))
    w1 = Window.partitionBy(*[F.col(g) for g in group], F.col("_salt")).orderBy(*order)
    cand = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
            .filter(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= n)
