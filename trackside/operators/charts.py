"""Chart-ready tables (CH-6..8, WN-8); rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.exprs import cluster_color, cluster_label


def normalize_profiles(profiles: DataFrame, features: list[str], *, by: str = "Cluster") -> DataFrame:
    """WN-8: min-max scale each feature across clusters to 0..1; a constant or
    all-null feature becomes 0.5. The ranges are one aggregate row over the profiles
    table (one row per cluster), read once and used as literals."""
    feats = [f for f in features if f in profiles.columns]
    rng = profiles.agg(*[e for f in feats for e in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))]).first()

    def scaled(f):
        lo, hi = rng[f"lo_{f}"], rng[f"hi_{f}"]
        if lo is None or hi is None or hi == lo:
            return F.lit(0.5).alias(f)
        return ((F.col(f) - F.lit(lo)) / F.lit(hi - lo)).alias(f)

    return profiles.select(by, *[scaled(f) for f in feats])


def radar_long(profiles: DataFrame, features: list[str] | None = None, *, by: str = "Cluster") -> DataFrame:
    """CH-7: normalised profiles in long form (by, Spoke, Feature, Value) with the
    first spoke repeated at the end to close each polygon."""
    feats = [f for f in (features or S.RADAR_FEATURES) if f in profiles.columns]
    norm = normalize_profiles(profiles, feats, by=by)
    spokes = F.array(*[F.struct(F.lit(i).alias("Spoke"), F.lit(f).alias("Feature"), F.col(f).cast("double").alias("Value"))
                       for i, f in enumerate(feats + feats[:1])])
    return norm.select(by, F.explode(spokes).alias("_s")).select(
        by, "_s.*", cluster_color(by).alias("Color"), cluster_label(by).alias("Label"))


def pca_scatter(labels: DataFrame, coords: DataFrame, *, id_col: str = S.DRIVER_COL) -> DataFrame:
    """CH-6: PCA coordinates with cluster label and colour (PC2 = 0.0 if absent)."""
    j = coords.join(labels, id_col, "inner")
    if "PC2" not in j.columns:
        j = j.withColumn("PC2", F.lit(0.0))
    return j.select(id_col, "PC1", "PC2", "Cluster", cluster_label("Cluster").alias("ClusterLabel"),
                    cluster_color("Cluster").alias("Color"))


def cluster_roster(labels: DataFrame, *, id_col: str = S.DRIVER_COL) -> DataFrame:
    """CH-8: drivers by (Cluster, Driver) with label and colour."""
    return labels.select(id_col, "Cluster", cluster_label("Cluster").alias("ClusterLabel"),
                         cluster_color("Cluster").alias("Color")).orderBy("Cluster", id_col)


def assignment_table(labels: DataFrame, coords: DataFrame, *, id_col: str = S.DRIVER_COL) -> DataFrame:
    """CH-8 / JN-7 (left): every labelled driver with its PCA coordinates, where there are any."""
    own = [c for c in coords.columns if c.startswith("PC")]
    return labels.select(id_col, "Cluster").join(coords.select(id_col, *own), id_col, "left").select(
        id_col, cluster_label("Cluster").alias("Cluster"), *own)


def centroid_table(profiles: DataFrame, *, by: str = "Cluster", digits: int = 2) -> DataFrame:
    """CH-8: cluster centroids rounded for display (half-even)."""
    return profiles.select(by, *[F.bround(F.col(c).cast("double"), digits).alias(c) for c in profiles.columns if c != by])


def display_sorted(df: DataFrame, kind: str, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """TK-1: presentation orderings of the small result tables: ``classification``
    (lap time, driver), ``corners`` (corner, min speed), ``assignments``
    (cluster, driver), ``trace`` (driver, time in lap). A global sort: use on
    per-driver / per-corner tables or after a filter, not on raw samples."""
    orders = {
        "classification": [*keys, "LapTime_seconds", S.DRIVER_COL],
        "corners": [*keys, "Corner", "Min_Speed", S.DRIVER_COL],
        "assignments": ["Cluster", S.DRIVER_COL],
        "trace": [*keys, S.DRIVER_COL, F.col(S.TIME_COL).asc_nulls_last()],
    }
    return df.orderBy(*[c for c in orders[kind] if not isinstance(c, str) or c in df.columns])
