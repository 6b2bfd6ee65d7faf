import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUICK = ["classification", "driver_summary", "corner_summary", "braking_zones", "lap_pct", "sector_ratios",
         "round_driver_features", "asof_nearest", "assign_laps", "stint_lookup", "silhouette_by_label",
         "radar_long", "speed_histogram", "top10_spread"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "Pos" in df.columns


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", QUICK)
def test_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in sdf.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=key)
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=key)
    assert a == b
