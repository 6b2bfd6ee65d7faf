import random

import pytest
from pyspark.sql import functions as F

from trackside.operators import align, intervals


@pytest.mark.parametrize("levels", [3, 20, 32])
def test_covers_are_disjoint_short_and_exact(spark, levels):
    rng = random.Random(2)
    pairs = [(a, a + rng.randrange(-1, 70)) for a in (rng.randrange(-90, 90) for _ in range(150))]
    pairs += [(0, 0), (-1, 0), (5, 4), (None, 3), (3, None), (0, 63), (-64, 63), (1, 62)]
    df = spark.createDataFrame(pairs, "lo long, hi long").withColumn("c", intervals.cover(F.col("lo"), F.col("hi"), levels))
    for r in df.collect():
        if r.lo is None or r.hi is None or r.lo > r.hi:
            assert not r.c
            continue
        held = sorted(x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert held == list(range(r.lo, r.hi + 1))


def test_long_intervals_have_few_nodes(spark):  # with levels for them
    """Ten years in hours, and the whole range of 32-bit numbers."""
    df = spark.createDataFrame([(3, 3 + 87_600), (-2**31, 2**31 - 1), (1, 2**31 - 2), (-2**32 + 1, 2**32 - 2)], "lo long, hi long")
    for r in df.withColumn("n", F.size(intervals.cover(F.col("lo"), F.col("hi"), 33))).collect():
        assert r.n <= 2 * (r.hi - r.lo + 1).bit_length()


def test_stab_matches_brute_force(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randrange(-200, 200)) for _ in range(200)] + [(None, 1), ("a", None)]
    spans = [(rng.choice("ab"), i, a, a + rng.choice([0, 1, 7, 90, 400])) for i in range(60) for a in [rng.randrange(-250, 200)]]
    spans += [(None, 900, 0, 5), ("a", 901, None, 5), ("b", 902, -10**9, 10**9)]
    got = intervals.stab(spark.createDataFrame(points, "k string, x long"), spark.createDataFrame(spans, "k string, i long, lo long, hi long"),
                         by=["k"], point="x", low="lo", high="hi")
    assert got.columns == ["k", "x", "i"]
    want = sorted((k, x, i) for k, x in points for j, i, a, b in spans
                  if k is not None and k == j and x is not None and a is not None and a <= x <= b)
    assert sorted((r.k, r.x, r.i) for r in got.collect()) == want


def test_a_lap_of_ten_years_meets_only_buckets_with_samples(spark):
    laps = spark.createDataFrame([(1, 1, 0.0, 315_360_000.0), (1, 2, 1000.0, 90.0)],
                                 "d int, lap_number int, date_start double, lap_duration double")
    samples = spark.createDataFrame([(1, t) for t in (5.0, 1000.0, 1090.0, 1090.5, 3e8, 4e8)], "d int, ts double")
    got = align.assign_laps(samples, laps, by=["d"], sample_ts="ts")
    assert sorted((r.ts, r.LapNumber) for r in got.collect()) == [(5.0, 1), (1000.0, 2), (1090.0, 2), (1090.5, 1), (3e8, 1)]


def test_an_endless_stint(spark):
    laps = spark.createDataFrame([(1, n) for n in (1, 2, 30, 10**6)], "d int, LapNumber int")
    stints = spark.createDataFrame([(1, 1, "SOFT", 1, 2), (1, 2, "HARD", 2, 2**31 - 1), (1, 3, "NONE", 9, 5), (1, 4, "X", None, 3)],
                                   "d int, stint_order int, compound string, lap_start int, lap_end int")
    got = align.stint_compounds(laps, stints, by=["d"]).collect()
    assert sorted((r.LapNumber, r.Compound, r.FreshTyre) for r in got) == [
        (1, "SOFT", True), (2, "SOFT", True), (30, "HARD", True), (10**6, "HARD", True)]
