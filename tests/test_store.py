"""The committed store, published runs, previews per session and the lap-clustered table."""

import os

import pytest
from pyspark.sql import functions as F

from trackside.operators import kinematics, zones
from trackside.sources import sinks, store
from tests.test_io import _raw


def _counts(spark, path):
    return {(r.Year, r.Round, r.SessionType): r["count"]
            for r in store.read_store(spark, path).groupBy("Year", "Round", "SessionType").count().collect()}


def test_sessions_are_replaced_as_a_whole(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "store")
    store.commit_sessions(_raw(spark, [1, 2]), path)
    assert _counts(spark, path) == {(2025, 1, "Q"): 5, (2025, 2, "Q"): 5}
    store.commit_sessions(_raw(spark, [2]).filter("TimeInLap < 3").withColumn("Extra", F.lit(1)), path)
    assert _counts(spark, path) == {(2025, 1, "Q"): 5, (2025, 2, "Q"): 3}
    got = store.read_store(spark, path)
    assert got.filter("Round = 2 AND Extra = 1").count() == 3 and got.filter("Round = 1 AND Extra IS NULL").count() == 5
    assert store.manifest(spark, path).count() == 3


def test_a_write_that_ends_half_way_is_not_there(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "store")
    expected = _raw(spark, [1, 2]).select("Year", "Round", "SessionType").distinct()
    assert store.missing_sessions(spark, expected, path).count() == 2
    store.commit_sessions(_raw(spark, [1]), path)
    store.write_version(_raw(spark, [1, 2]).filter("TimeInLap < 2"), path)  # data written, never committed
    assert _counts(spark, path) == {(2025, 1, "Q"): 5}
    assert [r.Round for r in store.missing_sessions(spark, expected, path).collect()] == [2]
    status = {r.Round: (r.q_ok, r.r_ok, r.processed_sessions, r.stored_rows) for r in store.ingest_status(spark, expected, path).collect()}
    assert status == {1: (True, False, 1, 5), 2: (False, False, 0, 0)}


def test_null_and_odd_session_keys(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "store")
    df = _raw(spark, [1]).withColumn("SessionType", F.when(F.col("sample_id") < 2, F.lit(None)).otherwise(F.lit("S/1 %=")))
    df = df.withColumn("Year", F.when(F.col("sample_id") != 4, F.col("Year"))).withColumn(
        "SessionType", F.when(F.col("sample_id") == 4, F.lit("007")).otherwise(F.col("SessionType")))
    store.commit_sessions(df, path)
    assert _counts(spark, path) == {(2025, 1, None): 2, (2025, 1, "S/1 %="): 2, (None, 1, "007"): 1}
    assert store.missing_sessions(spark, df.select("Year", "Round", "SessionType").distinct(), path).count() == 0
    plain = os.path.join(tmpdir_fresh, "plain")
    sinks.write_store(df, plain)
    found = {tuple(r) for r in sinks.written_sessions(spark, plain).collect()}
    assert found == {(2025, 1, None), (2025, 1, "S/1 %="), (None, 1, "007")}


def test_nothing_committed(spark, tmpdir_fresh):
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, os.path.join(tmpdir_fresh, "none"))
    store.commit_sessions(_raw(spark, [1]).filter("false"), os.path.join(tmpdir_fresh, "empty"))
    assert store.live_sessions(spark, os.path.join(tmpdir_fresh, "empty")).count() == 0


def test_a_run_is_published_as_a_whole(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "runs")
    one = {"a": spark.range(3), "b": spark.range(4)}
    store.publish_run(spark, path, one, {"k": 2})

    def fail(folder):
        raise RuntimeError("ended half way")

    with pytest.raises(RuntimeError):
        store.publish_run(spark, path, {"a": spark.range(9), "b": spark.range(9)}, {"k": 3}, save=fail)
    assert store.read_run(spark, path, "a").count() == 3 and store.latest_run(spark, path)["summary"] == {"k": 2}
    store.publish_run(spark, path, {"a": spark.range(5)}, {"k": 4})
    assert store.read_run(spark, path, "a").count() == 5
    with pytest.raises(FileNotFoundError):
        store.read_run(spark, path, "b")


def test_previews_of_every_session(spark, tmpdir_fresh):
    df = _raw(spark, [1, 2, 3]).unionByName(_raw(spark, [3]))
    got = sinks.previews(df, n_lines=4).collect()
    assert {r: sorted(x.TimeInLap for x in got if x.Round == r) for r in (1, 2, 3)} == {
        1: [0.0, 1.0, 2.0], 2: [0.0, 1.0, 2.0], 3: [0.0, 0.0, 1.0]}
    path = os.path.join(tmpdir_fresh, "previews")
    sinks.write_previews(df, path, n_lines=3)
    sinks.write_previews(_raw(spark, [2]), path, n_lines=2)
    read = spark.read.option("header", True).csv(path)
    assert {r.Round: r["count"] for r in read.groupBy("Round").count().collect()} == {1: 2, 2: 1, 3: 2}


def test_lap_operators_do_not_shuffle_a_clustered_table(spark, tmpdir_fresh):
    df = _raw(spark, [1, 2, 3])
    path, name = os.path.join(tmpdir_fresh, "clustered"), "clustered_" + os.path.basename(tmpdir_fresh).replace("-", "_")
    table = store.write_clustered(df, path, name, buckets=4)
    acc = kinematics.add_acceleration(table)
    plan = acc._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    want = kinematics.add_acceleration(df).select("sample_id", "Round", "Acceleration").collect()
    assert sorted(map(tuple, acc.select("sample_id", "Round", "Acceleration").collect()), key=str) == sorted(map(tuple, want), key=str)
    again = store.open_clustered(spark, path, name + "_again", df.schema, buckets=4)
    plan = kinematics.add_acceleration(again)._jdf.queryExecution().executedPlan().toString()
    assert again.count() == 15 and "Exchange" not in plan
    assert zones.mark_zones(acc).count() == 15
