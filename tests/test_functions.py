from pyspark.sql import functions as F

from trackside.functions import (accel_type, brake_numeric, clip_symmetric, format_gap, format_laptime,
                                 parse_duration_seconds, seconds_to_duration_text, slugify, event_prefix,
                                 driver_color, cluster_color, cluster_label)


def test_parse_duration_shapes(spark):
    rows = [("0 days 00:01:38.807000",), ("0:01:38.807000",), ("NaT",), ("<NA>",), ("",), (None,),
            ("1 days 00:00:01",), ("00:01:30",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(parse_duration_seconds("t")).collect()]
    assert got[0] == 98.807 and got[1] == 98.807
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None
    assert got[6] == 86401.0 and got[7] == 90.0


def test_brake_numeric_text_and_bool(spark):
    txt = spark.createDataFrame([("true",), ("false",), ("True",), (" false ",), ("1",), ("0",), ("1.0",),
                                 ("100",), (None,)], "b string")
    assert [r[0] for r in txt.select(brake_numeric("b")).collect()] == [1, 0, 1, 0, 1, 0, 0, 0, 0]
    bl = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    t = bl.schema["b"].dataType
    assert [r[0] for r in bl.select(brake_numeric("b", t)).collect()] == [1, 0, 0]


def test_clip_and_accel_type_nulls(spark):
    df = spark.createDataFrame([(None,), (20.0,), (-20.0,), (0.5,), (-0.6,), (0.51,)], "a double")
    got = df.select(clip_symmetric("a").alias("c"), accel_type("a").alias("t")).collect()
    assert [r.c for r in got] == [None, 15.0, -15.0, 0.5, -0.6, 0.51]
    assert [r.t for r in got] == [None, "Acceleration", "Deceleration", "Neutral", "Deceleration", "Acceleration"]


def test_formatting(spark):
    df = spark.createDataFrame([(98.807,), (None,), (0.0,), (61.0004,)], "s double")
    got = df.select(format_laptime("s").alias("l"), format_gap("s").alias("g"),
                    seconds_to_duration_text("s").alias("d")).collect()
    assert [r.l for r in got] == ["1:38.807", "—", "0:00.000", "1:01.000"]
    assert [r.g for r in got] == ["+98.807", None, "—", "+61.000"]
    assert got[0].d == "0 days 00:01:38.807000" and got[2].d is None


def test_slug_prefix_colours(spark):
    df = spark.createDataFrame([("São Paulo", 21, "ver", 9), ("  United States ", 3, "XXX", 3)],
                               "c string, r int, d string, k int")
    got = df.select(slugify("c").alias("s"), event_prefix("r", "c").alias("p"), driver_color("d").alias("col"),
                    cluster_color("k").alias("cc"), cluster_label("k").alias("cl")).collect()
    assert got[0].s == "s_o_paulo" and got[0].p == "r21_s_o_paulo"
    assert got[1].s == "united_states" and got[1].p == "r03_united_states"
    assert got[0].col == "#1B2A4A" and got[1].col == "#9AA0A6"
    assert got[0].cc == "#4ECDC4" and got[1].cc == "#96CEB4" and got[0].cl == "Cluster 9"
