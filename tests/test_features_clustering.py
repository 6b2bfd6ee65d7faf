"""The analysed project's clustering test, re-created with Spark expressions:
6 drivers x 2 rounds, one 400-sample lap each; k=2 must give 2 clusters, 6
labels, silhouette > 0, and the same labels after save/load/predict."""

import math
import os
import random

from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S
from trackside.operators import clustering, common, features, kinematics
from trackside.plans import q_features
from trackside.sources import adapter

DRIVERS = {  # driver: ((brake_bias, speed_scale) round 1, round 2)
    "VER": ((0.20, 1.10), (0.22, 1.09)), "NOR": ((0.20, 1.08), (0.21, 1.07)),
    "PIA": ((0.25, 1.07), (0.24, 1.06)), "HAM": ((0.60, 0.95), (0.58, 0.94)),
    "LEC": ((0.55, 0.97), (0.57, 0.96)), "ALO": ((0.70, 0.90), (0.72, 0.89)),
}
NUMBERS = {"VER": "1", "NOR": "4", "PIA": "81", "HAM": "44", "LEC": "16", "ALO": "14"}


def synthetic_season(spark, n_points=400):
    rows = [(d, NUMBERS[d], rnd + 1, bias, scale) for d, params in DRIVERS.items()
            for rnd, (bias, scale) in enumerate(params)]
    base = spark.createDataFrame(rows, "Driver string, DriverNumber string, Round int, bias double, scale double")
    t = F.col("i") * 90.0 / (n_points - 1)
    brake = F.pmod(t, F.lit(20.0)) < (2.0 + 3.0 * F.col("bias"))
    speed = F.col("scale") * (80.0 + 120.0 * F.pow(F.sin(t / 14.0), 2))
    df = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i"))
    return df.select(
        F.lit(2025).alias("Year"), "Round", F.lit("Q").alias("SessionType"), "DriverNumber", "Driver",
        F.lit(1).alias("LapNumber"), t.alias("TimeInLap"),
        (100.0 - 80.0 * brake.cast("double")).alias("Throttle"), brake.alias("Brake"), F.lit(0).alias("DRS"),
        (9000.0 + 10.0 * speed).alias("RPM"), speed.alias("Speed"),
        (F.cos(t / 10.0) * 1000.0 + F.ascii("Driver")).alias("X"), (F.sin(t / 10.0) * 1000.0).alias("Y"),
        F.lit(0.0).alias("Z"), F.lit("0 days 00:01:30.000000").alias("LapTime"),
        *[F.lit("0 days 00:00:30.000000").alias(f"Sector{k}Time") for k in (1, 2, 3)],
        F.lit("SOFT").alias("Compound"), F.lit(True).alias("FreshTyre"), F.col("i").cast("long").alias("sample_id"))


def test_features_matrix_and_clusters(spark, tmpdir_fresh):
    tel = kinematics.add_acceleration(synthetic_season(spark))
    per_round = features.round_driver_features(tel)
    assert per_round.count() == 12
    row = per_round.filter("Driver = 'VER' AND Round = 1").first()
    assert row.Sector1_Ratio == 1.0 and row.Brake_Zones >= 1 and 0 < row.Brake_Pct < 100
    fm = features.driver_feature_matrix(per_round)
    assert fm.count() == 6
    # all sector ratios equal 1.0 -> constant within each round -> z-score 0.0
    assert {r.Sector1_Ratio for r in fm.collect()} == {0.0}
    res = clustering.fit_driver_clusters(fm, n_clusters=2)
    labels = {r.Driver: r.Cluster for r in res.labels.collect()}
    assert res.n_clusters == 2 and len(labels) == 6 and len(set(labels.values())) == 2
    assert res.silhouette > 0
    assert labels["VER"] == labels["NOR"] == labels["PIA"] != labels["HAM"] == labels["LEC"] == labels["ALO"]
    path = os.path.join(tmpdir_fresh, "model")
    clustering.save_clustering_model(res, path)
    art = clustering.load_clustering_model(spark, path)
    again = {r.Driver: r.Cluster for r in clustering.predict_driver_clusters(fm, art).collect()}
    assert again == labels
    pcs = res.pca_coords.collect()
    assert len(pcs) == 6 and all(not math.isnan(r.PC1) for r in pcs)


def test_zscore_single_driver_and_constant(spark):
    cols = S.STYLE_FEATURE_COLUMNS
    rows = [(2025, 1, "Q", "VER", *[1.0] * len(cols)), (2025, 2, "Q", "VER", *[2.0] * len(cols)),
            (2025, 2, "Q", "NOR", *[None] * len(cols))]
    schema = "Year int, Round int, SessionType string, Driver string, " + ", ".join(f"{c} double" for c in cols)
    z = features.zscore_within_round(spark.createDataFrame(rows, schema)).collect()
    # round 1: one driver (std null) -> 0.0; round 2: one non-null value -> constant -> 0.0 (null cells too)
    assert len(z) == 3 and all(r.Avg_Speed == 0.0 for r in z)


def test_silhouette_matches_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(0, 1, (15, 3)), rng.normal(4, 1, (12, 3)), rng.normal((0, 5, 0), 1, (1, 3))])
    lab = [0] * 15 + [1] * 12 + [2]
    df = spark.createDataFrame([(str(i), int(l), *map(float, p)) for i, (p, l) in enumerate(zip(pts, lab))],
                               "Driver string, Cluster int, a double, b double, c double")
    vec = clustering.assemble(df, ["a", "b", "c"])
    got = {r.Driver: r.silhouette for r in clustering.silhouette_points(vec).collect()}
    D = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    lab = np.array(lab)
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            exp = 0.0
        else:
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
            exp = (b - a) / max(a, b)
        assert math.isclose(got[str(i)], exp, rel_tol=1e-9, abs_tol=1e-9)


def test_silhouette_keeps_its_digits_far_from_zero_and_runs_no_python(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    pts, lab = np.round(rng.normal(size=(60, 3)), 3), rng.integers(0, 4, 60).tolist()
    def score(shift):
        df = spark.createDataFrame([(str(i), int(c), *[float(x + shift) for x in p]) for i, (c, p) in enumerate(zip(lab, pts))],
                                   "Driver string, Cluster int, a double, b double, c double")
        out = clustering.silhouette_points(clustering.assemble(df, ["a", "b", "c"]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
        return {r.Driver: r.silhouette for r in out.collect()}
    near, far = score(0.0), score(1e8)
    assert all(math.isclose(near[k], far[k], abs_tol=1e-6) for k in near)


def test_season_clustering_job_writes_outputs(spark, tmpdir_fresh):
    from trackside.plans.jobs import season_clustering_job
    from trackside.sources import store
    tel = kinematics.add_acceleration(synthetic_season(spark, n_points=120))
    out = os.path.join(tmpdir_fresh, "season")
    summary = season_clustering_job(spark, tel, out, n_clusters=2)
    assert summary["n_rounds"] == 2 and summary["n_drivers"] == 6 and summary["n_clusters"] == 2
    for t in ("round_features", "feature_matrix", "labels", "pca", "profiles"):
        assert store.read_run(spark, out, t).count() > 0
    run = store.latest_run(spark, out)
    assert run["summary"] == summary
    art = clustering.load_clustering_model(spark, os.path.join(run["folder"], "model"))
    assert art["n_clusters"] == 2 and len(art["feature_columns"]) >= 20


def test_season_job_guard(spark, tmpdir_fresh):
    import pytest
    from trackside.plans.jobs import season_clustering_job
    tel = kinematics.add_acceleration(synthetic_season(spark, n_points=120).filter("Driver IN ('VER', 'NOR')"))
    with pytest.raises(ValueError):
        season_clustering_job(spark, tel, os.path.join(tmpdir_fresh, "x"), n_clusters=2)


def _vectors(spark, rows):
    schema = T.StructType([T.StructField("Driver", T.StringType()), T.StructField("features", VectorUDT())])
    return clustering.cut_lineage(spark.createDataFrame([(str(i), Vectors.dense(v)) for i, v in enumerate(rows)], schema).repartition(3))


def test_fits_of_all_k_and_seeds_share_their_passes(spark, monkeypatch):
    """The centres are those of one ``pyspark.ml`` fit a seed, and a pass moves every fit not converged yet."""
    rng = random.Random(4)
    vec = _vectors(spark, [[rng.gauss(c, 1.0) for _ in range(5)] for c in (0, 3, 9) for _ in range(150)])
    passes, sums = [], clustering._centre_sums
    monkeypatch.setattr(clustering, "_centre_sums", lambda blocks, fits, slots: passes.append(len(fits)) or sums(blocks, fits, slots))
    got = clustering.fit_kmeans_each(vec, [2, 4], seed=5, n_init=3, features_col="features")
    longest = 0
    for k, model in got.items():
        plain = [KMeans(k=k, seed=5 + i, maxIter=300, tol=1e-4).fit(vec) for i in range(3)]
        longest = max(longest, *[m.summary.numIter for m in plain])
        best = min(plain, key=lambda m: round(m.summary.trainingCost, 9))
        a, b = (sorted(map(tuple, m.clusterCenters())) for m in (model, best))
        assert len(a) == k and all(math.isclose(x, y, abs_tol=1e-9) for p, q in zip(a, b) for x, y in zip(p, q))
    assert passes[0] == 6 and len(passes) == longest


def test_fits_with_fewer_distinct_rows_than_centres(spark):
    vec = _vectors(spark, [[0.0, 1.0]] * 20 + [[5.0, 5.0]] * 7)
    model = clustering.fit_kmeans(vec, 4, n_init=2)
    assert sorted(map(tuple, model.clusterCenters())) == [(0.0, 1.0), (5.0, 5.0)]
    assert {r._raw for r in model.transform(vec).collect()} == {0, 1}


def _lap_exchanges(monkeypatch, call):
    """The exchanges on the lap below the lap features that ``call`` makes."""
    seen, real = [], features.all_lap_features
    monkeypatch.setattr(features, "all_lap_features", lambda df, **kw: seen.append(real(df, **kw)) or seen[-1])
    out = call()
    text = seen[-1]._jdf.queryExecution().executedPlan().toString()
    return out, [line for line in text.splitlines() if "LapNumber" in line and "hashpartitioning" in line]


def test_feature_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    tel = clustering.cut_lineage(kinematics.add_acceleration(synthetic_season(spark)).withColumn("Year", F.col("Round") + 2023))
    key = lambda rows: sorted(tuple(r) for r in rows)
    plain = key(features.round_driver_features(tel, exact_mean=True).collect())
    monkeypatch.setattr(common, "LAP_TASK_ROWS", 100)
    split, deals = _lap_exchanges(monkeypatch, lambda: features.round_driver_features(tel, exact_mean=True))
    assert key(split.collect()) == plain
    n = -(-tel.count() // 100)
    assert deals and all(f", {n}), REPARTITION_BY_NUM" in line for line in deals), deals


def test_the_dealt_view_has_the_same_rows_and_one_exchange(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(str, df.collect()))
    plain = key(adapter.telemetry_view(spark, sf))
    monkeypatch.setattr(common, "LAP_TASK_ROWS", 50)
    dealt = adapter.telemetry_view(spark, sf, dealt=True)
    assert key(dealt) == plain
    _, deals = _lap_exchanges(monkeypatch, lambda: q_features.rdf(spark, sf))
    assert len(deals) == 1 and "REPARTITION_BY_NUM" in deals[0], deals
