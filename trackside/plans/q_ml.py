"""Queries: imputation/scaling, silhouette, profiles, radar, k-means, PCA,
model round trip and cluster tables (ML-*, AG-16, WN-8, CH-6..8)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.operators import charts, clustering
from trackside.plans.common import round6
from trackside.plans.registry import register
from trackside.sources.adapter import read_table
from trackside.session import checkpoint_dir, cut_lineage

DIMS = [f"d{i}" for i in range(64)]
# some cells are blanked by a rule on the id, so that imputation has work to do
BLANK_EVERY = 7


def emb_matrix(spark, sf, *, blanks: bool = False):
    """Embeddings as a matrix: id ``Driver`` (vec_id as text), one column per dimension."""
    e = read_table(spark, sf, "embeddings")

    def cell(i):
        v = F.col("embedding")[i].cast("double")
        return F.when(F.col("vec_id") % BLANK_EVERY != i % BLANK_EVERY, v) if blanks else v

    return e.select(F.col("vec_id").cast("string").alias("Driver"), F.col("label").alias("Cluster"),
                    *[cell(i).alias(d) for i, d in enumerate(DIMS)])


@register("impute_scale", f"""
m AS (SELECT vec_id, {", ".join(f'CASE WHEN vec_id % {BLANK_EVERY} <> {i % BLANK_EVERY} THEN CAST(embedding[{i + 1}] AS DOUBLE) END AS d{i}' for i in range(64))} FROM embeddings),
mu AS (SELECT {", ".join(f'avg(d{i}) AS mu{i}' for i in range(64))} FROM m),
f AS (SELECT vec_id, {", ".join(f'COALESCE(d{i}, mu{i}) AS d{i}' for i in range(64))} FROM m, mu),
st AS (SELECT {", ".join(f'avg(d{i}) AS mu{i}, stddev_pop(d{i}) AS sd{i}' for i in range(64))} FROM f)
---
SELECT CAST(vec_id AS VARCHAR) AS "Driver",
  {", ".join(f'round(CASE WHEN sd{i} IS NULL OR sd{i} = 0 THEN 0.0 ELSE (d{i} - mu{i}) / sd{i} END, 6) AS d{i}' for i in range(64))}
FROM f, st""", adapter=False)
def q_impute_scale(spark, sf):
    """ML-1 + ML-2 on all embedding dimensions, a seventh of the cells blank."""
    m = emb_matrix(spark, sf, blanks=True).drop("Cluster")
    means = clustering.column_means(m, DIMS)
    imp = clustering.impute_means(m, DIMS, means)
    return round6(clustering.apply_scaler(imp, DIMS, clustering.fit_scaler(imp, DIMS)), DIMS)


SIL_SQL = """
p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cnt AS (SELECT label, count(*) AS n FROM p GROUP BY label),
dist AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s
         FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT d.vec_id, d.own,
              max(CASE WHEN d.other = d.own THEN d.s / (c.n - 1) END) AS a,
              min(CASE WHEN d.other <> d.own THEN d.s / c2.n END) AS b
       FROM dist d JOIN cnt c ON c.label = d.own JOIN cnt c2 ON c2.label = d.other GROUP BY ALL),
sil AS (SELECT p.vec_id, p.label, CASE WHEN c.n > 1 THEN (ab.b - ab.a) / greatest(ab.a, ab.b) ELSE 0.0 END AS s
        FROM p JOIN cnt c USING (label) LEFT JOIN ab USING (vec_id))"""


def _emb_points(spark, sf):
    m = emb_matrix(spark, sf)
    return clustering.assemble(m, DIMS).select("Driver", "Cluster", "features")


@register("silhouette_by_label", SIL_SQL + """
---
SELECT CAST(vec_id AS VARCHAR) AS "Driver", label AS "Cluster", round(s, 6) AS silhouette FROM sil""",
          adapter=False)
def q_silhouette_by_label(spark, sf):
    """ML-4: silhouette (squared Euclidean) of every embedding, clusters = label."""
    return round6(clustering.silhouette_points(_emb_points(spark, sf)), ["silhouette"])


@register("silhouette_score", SIL_SQL + """
---
SELECT round(avg(s), 6) AS silhouette FROM sil""", adapter=False)
def q_silhouette_score(spark, sf):
    return round6(clustering.silhouette_points(_emb_points(spark, sf)).agg(F.avg("silhouette").alias("silhouette")),
                  ["silhouette"])


PROF_SQL = f"""
prof AS (SELECT label AS "Cluster", {", ".join(f'avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS d{i}' for i in range(64))}
         FROM embeddings GROUP BY label)"""


@register("cluster_profiles", PROF_SQL + f"""
---
SELECT "Cluster", {", ".join(f'round(d{i}, 6) AS d{i}' for i in range(64))} FROM prof""", adapter=False)
def q_cluster_profiles(spark, sf):
    """AG-16: mean features per cluster (embedding label as the cluster)."""
    m = emb_matrix(spark, sf)
    return round6(m.groupBy("Cluster").agg(*[F.avg(d).alias(d) for d in DIMS]), DIMS)


@register("cluster_centroids", """
SELECT label AS "Cluster", """ + ", ".join(f"round_even(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 2) AS d{i}" for i in range(64))
          + " FROM embeddings GROUP BY label", adapter=False)
def q_cluster_centroids(spark, sf):
    """CH-8: centroids rounded to 2."""
    m = emb_matrix(spark, sf)
    return charts.centroid_table(m.groupBy("Cluster").agg(*[F.avg(d).alias(d) for d in DIMS]))


@register("cluster_assignments", """
SELECT CAST(vec_id AS VARCHAR) AS "Driver", 'Cluster ' || CAST(label AS VARCHAR) AS "Cluster",
       CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[1] AS DOUBLE) END AS "PC1",
       CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[2] AS DOUBLE) END AS "PC2" FROM embeddings""", adapter=False)
def q_cluster_assignments(spark, sf):
    """CH-8 / JN-7 (left): labels with coordinates, where there are any."""
    m = emb_matrix(spark, sf)
    coords = m.filter(F.col("Driver").cast("long") % 3 > 0).select("Driver", F.col("d0").alias("PC1"), F.col("d1").alias("PC2"))
    return charts.assignment_table(m.select("Driver", "Cluster"), coords)


_PALETTE_CASE = "CASE \"Cluster\" % 8 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(S.CLUSTER_PALETTE)) + " END"


@register("radar_long", PROF_SQL + "," + f"""
rng AS (SELECT {", ".join(f'min(d{i}) AS lo{i}, max(d{i}) AS hi{i}' for i in range(64))} FROM prof),
norm AS (SELECT "Cluster", {", ".join(f'CASE WHEN lo{i} IS NULL OR hi{i} IS NULL OR hi{i} = lo{i} THEN 0.5 ELSE (d{i} - lo{i}) / (hi{i} - lo{i}) END AS d{i}' for i in range(64))}
         FROM prof, rng)
---
SELECT "Cluster", "Spoke", "Feature", round("Value", 6) AS "Value", {_PALETTE_CASE} AS "Color",
       'Cluster ' || CAST("Cluster" AS VARCHAR) AS "Label"
FROM (
  {" UNION ALL ".join(f"SELECT \"Cluster\", {j} AS \"Spoke\", 'd{i}' AS \"Feature\", d{i} AS \"Value\" FROM norm"
                      for j, i in enumerate(list(range(64)) + [0]))})""", adapter=False)
def q_radar_long(spark, sf):
    """WN-8 + CH-7 on cluster profiles of all embedding dimensions."""
    m = emb_matrix(spark, sf)
    prof = m.groupBy("Cluster").agg(*[F.avg(d).alias(d) for d in DIMS])
    return round6(charts.radar_long(prof, DIMS), ["Value"])


@register("cluster_palette", f"""
SELECT DISTINCT label AS "Cluster", {_PALETTE_CASE.replace('"Cluster"', 'label')} AS "Color",
       'Cluster ' || CAST(label AS VARCHAR) AS "Label" FROM embeddings""", adapter=False)
def q_cluster_palette(spark, sf):
    """SC-15: colour and label text of every cluster id (embedding labels)."""
    from trackside.functions import cluster_color, cluster_label
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("Cluster")).distinct()
    return e.select("Cluster", cluster_color("Cluster").alias("Color"), cluster_label("Cluster").alias("Label"))


# --------------------------------------------------------------------------- #
# Fitted models: k-means, k choice, PCA, model round trip.
# --------------------------------------------------------------------------- #
def _fit(spark, sf, k=None, **parts):
    m = emb_matrix(spark, sf, blanks=True).drop("Cluster")
    return clustering.fit_driver_clusters(m, n_clusters=k, cols=DIMS, **parts)


@register("kmeans_labels")
def q_kmeans_labels(spark, sf):
    """ML-3 + ML-7: k-means (k=4, 10 seeds) on the scaled embedding matrix."""
    return _fit(spark, sf, 4, score=False, pca=False).labels


ALL_TRUE = """SELECT CAST(vec_id AS VARCHAR) AS "Driver", TRUE AS "{}" FROM embeddings"""


@register("kmeans_nearest", ALL_TRUE.format("Nearest"), adapter=False)
def q_kmeans_nearest(spark, sf):
    """ML-3: every point carries the label of the centre nearest to it (constant true)."""
    r = _fit(spark, sf, 4, score=False, pca=False)
    v = vector_to_array(F.col("features"))
    back = {label: raw for raw, label in r.label_map.items()}
    centres = r.kmeans.clusterCenters()
    far = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in centres[back[c]]]), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda acc, x: acc + x) for c in sorted(back)]
    return r.scaled.withColumn("_d", F.array(*far)).select(
        "Driver", (F.element_at("_d", F.col("Cluster") + 1) <= F.array_min("_d") + 1e-9).alias("Nearest"))


@register("best_k")
def q_best_k(spark, sf):
    """ML-5: silhouette-based choice of k in [3, 8] (one row per tried k)."""
    m = emb_matrix(spark, sf, blanks=True).drop("Cluster")
    means = clustering.column_means(m, DIMS)
    imp = clustering.impute_means(m, DIMS, means)
    x = clustering.apply_scaler(imp, DIMS, clustering.fit_scaler(imp, DIMS))
    vec = cut_lineage(clustering.assemble(x, DIMS).select("Driver", "features"))
    best, scores = clustering.find_best_k(vec)
    return spark.createDataFrame([(k, float(v), k == best) for k, v in sorted(scores.items())],
                                 "k int, silhouette double, chosen boolean")


def _labelings_sql():
    """Silhouettes of the labelings vec_id % k by the moments of their clusters, in plain SQL."""
    scored = " UNION ALL ".join(f"SELECT {k} AS k, vec_id, CAST(vec_id % {k} + label * (vec_id % 2) AS INTEGER) AS c, x FROM v"
                                for k in range(3, 9))
    return f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings),
l AS ({scored}),
u AS (SELECT k, c, count(*) AS n, sum(list_inner_product(x, x)) AS q FROM l GROUP BY k, c),
e AS (SELECT k, c, list(s ORDER BY i) AS s FROM (SELECT k, c, i, sum(xi) AS s
      FROM (SELECT k, c, unnest(range(1, 65)) AS i, unnest(x) AS xi FROM l) GROUP BY k, c, i) GROUP BY k, c),
d AS (SELECT l.k, l.vec_id, l.c, u.c AS o, u.n, greatest(u.n * list_inner_product(x, x) - 2 * list_inner_product(x, e.s) + u.q, 0) AS d
      FROM l JOIN u ON u.k = l.k JOIN e ON e.k = u.k AND e.c = u.c),
ab AS (SELECT k, vec_id, max(n) FILTER (o = c) AS n, max(d) FILTER (o = c) AS own, min(d / n) FILTER (o <> c) AS b FROM d GROUP BY k, vec_id),
sc AS (SELECT k, avg(CASE WHEN n > 1 THEN (b - own / (n - 1)) / greatest(own / (n - 1), b) ELSE 0 END) AS s FROM ab GROUP BY k)"""


@register("best_labeling", _labelings_sql() + """
---
SELECT CAST(k AS INTEGER) AS k, round(s, 6) AS silhouette, k = (SELECT arg_min(k, (-s, k)) FROM sc) AS chosen FROM sc""", adapter=False)
def q_best_labeling(spark, sf):
    """ML-5: the choice of k among given labelings of the embeddings, scored in one stacked pass."""
    m = emb_matrix(spark, sf).withColumn("_id", F.col("Driver").cast("long"))
    vec = clustering.assemble(m, DIMS).select("_id", "Cluster", "features")
    labels = {k: (F.col("_id") % k + F.col("Cluster") * (F.col("_id") % 2)).cast("int") for k in range(3, 9)}
    points = cut_lineage(vec.select("features", *[c.alias(f"k{k}") for k, c in labels.items()]))
    return round6(clustering.score_labelings(points, {k: f"k{k}" for k in labels}), ["silhouette"])


_D = 64
_POWER_STEPS = 3000


def _power(name: str, matrix: str) -> str:
    """The leading eigenvector of a symmetric matrix (list of rows) by power iteration."""
    start = "[" + ", ".join(str(1.0 + i / 64) for i in range(_D)) + "]"
    return f"""{name}_it AS (WITH RECURSIVE it(n, v) AS (
  SELECT 0, CAST({start} AS DOUBLE[]) UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w)))
  FROM (SELECT n, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM it, {matrix} WHERE n < {_POWER_STEPS}))
  SELECT v FROM it WHERE n = {_POWER_STEPS}),
{name} AS (SELECT list_transform(v, lambda x: x * CASE WHEN list_extract(v, list_position(list_transform(v, lambda y: abs(y)),
      list_max(list_transform(v, lambda y: abs(y))))) < 0 THEN -1 ELSE 1 END) AS v FROM {name}_it)"""


@register("pca_projection", f"""
x AS (SELECT vec_id, unnest(range(1, {_D + 1})) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT x.vec_id, list((x.x - s.m) / s.sd ORDER BY x.i) AS z FROM x
      JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY i) s USING (i) GROUP BY x.vec_id),
c AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM (
      SELECT i, j, sum(z[i] * z[j]) / (count(*) - 1) AS s
      FROM z, (SELECT unnest(range(1, {_D + 1})) AS i), (SELECT unnest(range(1, {_D + 1})) AS j) GROUP BY i, j) GROUP BY i)),
{_power("p1", "c")},
c2 AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - lam * v[i] * v[j])) AS m
       FROM (SELECT m, v, list_inner_product(list_transform(m, lambda r: list_inner_product(r, v)), v) AS lam FROM c, p1)),
{_power("p2", "c2")}
---
SELECT CAST(vec_id AS VARCHAR) AS "Driver", round(list_inner_product(z, p1.v), 6) AS "PC1", round(list_inner_product(z, p2.v), 6) AS "PC2"
FROM z, p1, p2""", adapter=False)
def q_pca_projection(spark, sf):
    """ML-6: the two leading components of the standardised embeddings; the oracle finds them by power iteration."""
    m = emb_matrix(spark, sf).drop("Cluster")
    vec = cut_lineage(clustering.assemble(clustering.apply_scaler(m, DIMS, clustering.fit_scaler(m, DIMS)), DIMS).select("Driver", "features"))
    coords, _, _ = clustering.pca_coordinates(vec, len(DIMS), vec.count())
    return round6(coords, ["PC1", "PC2"])


@register("pca_coords")
def q_pca_coords(spark, sf):
    """ML-6 + CH-6: PCA scatter of the clustered matrix."""
    r = _fit(spark, sf, 4, score=False)
    return charts.pca_scatter(r.labels, r.pca_coords)


@register("cluster_roster")
def q_cluster_roster(spark, sf):
    """CH-8: drivers by cluster."""
    return charts.cluster_roster(_fit(spark, sf, 4, score=False, pca=False).labels)


@register("predict_roundtrip", ALL_TRUE.format("Same"), adapter=False)
def q_predict_roundtrip(spark, sf):
    """SNK-7 + ML-8: save, load and predict; ``Same`` tells whether label and PCA
    coordinates after the round trip equal the fitted ones (constant true)."""
    r = _fit(spark, sf, 4, score=False)
    # models go to the shared checkpoint folder, else the session's warehouse folder
    base = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    path = base.rstrip("/") + f"/trackside_models/emb_k4_{uuid.uuid4().hex}"
    clustering.save_clustering_model(r, path)
    art = clustering.load_clustering_model(spark, path)
    m = emb_matrix(spark, sf, blanks=True).drop("Cluster")
    pred = clustering.predict_driver_clusters(m, art).withColumnRenamed("Cluster", "Predicted")
    again = clustering.predict_pca(m, art).select("Driver", F.col("PC1").alias("_1"), F.col("PC2").alias("_2"))
    return (r.labels.join(r.pca_coords, "Driver").join(pred, "Driver").join(again, "Driver")
            .select("Driver", ((F.col("Cluster") == F.col("Predicted")) & (F.abs(F.col("PC1") - F.col("_1")) < 1e-9)
                               & (F.abs(F.col("PC2") - F.col("_2")) < 1e-9)).alias("Same")))


@register("season_clusters")
def q_season_clusters(spark, sf):
    """PL-6 core: driver feature matrix of the adapter -> k-means with k chosen by
    silhouette -> labels with PCA coordinates."""
    from trackside.plans.q_features import rdf
    from trackside.operators import features
    fm = features.driver_feature_matrix(rdf(spark, sf))
    r = clustering.fit_driver_clusters(fm)
    return charts.pca_scatter(r.labels, r.pca_coords)
