"""The driver feature matrix of a growing season (PL-5, PL-6, WN-6, AG-15), session by session.

Z-scores depend on their own session only, and the matrix on each driver's z-scores only.
So two committed stores (``sources.store``) hold the features and the z-scores per session and
driver; a new or changed session replaces its own rows, and the matrix is one partial
aggregate over the z-scores. Next to them stand the moments of every session and
feature (n, mean, sum of squared deviations, least, greatest), which merge into those of
the season without any feature row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators.features import zscore_within_round
from trackside.session import cut_lineage
from trackside.sources import store
from trackside.sources.sinks import STORE_PARTITIONS


def moments(features: DataFrame, *, keys: list[str] = S.SESSION_KEYS, cols: list[str] | None = None) -> DataFrame:
    """(keys, Feature, n, mean, m2, lo, hi) of every feature over the non-null values; one partial aggregate."""
    cols = [c for c in (cols or S.STYLE_FEATURE_COLUMNS) if c in features.columns]
    long = features.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("f")).select(*keys, "f.*")
    return long.groupBy(*keys, "Feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))


def merge_moments(parts: DataFrame, *, by: list[str]) -> DataFrame:
    """Moments of the union of disjoint sets of values, from theirs: the deviations of the parts' means
    from the common mean are added to their own. Parts without values change nothing."""
    some = parts.filter("n > 0")
    common = some.groupBy(*by).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    return (some.join(common, by).groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("m2"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def add_sessions(spark: SparkSession, per_round: DataFrame, path: str) -> None:
    """Put per-round features (PL-4) of new or changed sessions into the season's stores.

    A session may arrive in parts: rows of drivers that are not in ``per_round`` stay. Only
    the touched sessions are read and scored again. The z-scores are committed last,
    so a run that ends half way changes no matrix and can be repeated."""
    keys = list(S.SESSION_KEYS)
    new = cut_lineage(per_round)
    if new.isEmpty():
        return
    rows = new
    if store.manifest(spark, f"{path}/features").count():
        old = store.read_store(spark, f"{path}/features")
        touched = new.select(*keys).distinct()
        old = old.join(touched, [old[k].eqNullSafe(touched[k]) for k in keys], "left_semi")
        old = old.join(new, [old[k].eqNullSafe(new[k]) for k in [*keys, S.DRIVER_COL]], "left_anti")
        rows = cut_lineage(new.unionByName(old, allowMissingColumns=True))
    store.commit_sessions(rows, f"{path}/features")
    store.commit_sessions(moments(rows), f"{path}/moments")
    store.commit_sessions(zscore_within_round(rows), f"{path}/zscores")


def season_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The driver feature matrix of everything added so far (equal to PL-5 over all sessions at once)."""
    z = store.read_store(spark, f"{path}/zscores")
    cols = [c for c in S.STYLE_FEATURE_COLUMNS if c in z.columns]
    return z.groupBy(S.DRIVER_COL).agg(*[F.avg(c).alias(c) for c in cols])


def season_moments(spark: SparkSession, path: str) -> DataFrame:
    """Feature, n, mean, std (sample), lo, hi over the season, merged from the sessions' moments."""
    merged = merge_moments(store.read_store(spark, f"{path}/moments").drop(*STORE_PARTITIONS), by=["Feature"])
    return merged.select("Feature", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), "lo", "hi")
