from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
import __spark_entry__ as entry
from trackside.llm import common, langid, queries

import test_decontaminate
import test_exact_dedup
import test_mixing
import test_simhash


def as_rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stage_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "mixing"]
    assert entry.queries()["pipeline"] is cp.run


def test_run_matches_brute_force(spark):
    """Every stage by brute force; the language stage by what its rule rejects."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = as_rows(table)
    model = queries.language_model(table)
    rows = [r for r in rows if not langid.rejected(model, r[1])]
    best = test_exact_dedup.expected(rows)
    rows = [r for r in rows if best[test_exact_dedup.norm(r[1])][0] == r[0]]
    stay = test_simhash.survivors(rows)
    rows = [r for r in rows if (r[0], test_simhash.brute_fp(r[1])) in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, *_ in test_decontaminate.brute(rows, items)}
    rows = [r for r in rows if r[0] not in dirty]
    rate = test_mixing.rates(rows)
    want = Counter((i, s, k + 1) for i, _, _, s in rows for k in range(test_mixing.copies(i, rate[s])))
    got = cp.run(spark, sf)
    assert got.columns == [*table.columns, "rate", "n_copies", "copy_no", "shuffle_key"]
    assert Counter((r.doc_id, r.source, r.copy_no) for r in got.collect()) == want


def test_stages_keep_columns_and_take_odd_rows(spark, docs, clashing, empty):
    sf = "/root/testdata/sf0.001"
    for table in (docs, clashing, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf)
            if name != "mixing":
                assert out.columns == table.columns
            assert (out.count() > 0) == (table is not empty)


def test_only_texts_go_to_python(spark):
    """Texts of the rows do not come back from Python, and batches of texts are bounded by bytes, not by rows only."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for stage in (cp.language_id, cp.clean):
        plan = stage(spark, table, sf)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    before = spark.conf.get(common.BATCH_CONF)
    with common.bounded_batches(spark):
        text = "word " * 2000
        rows = spark.createDataFrame([(i, text) for i in range(3000)], "doc_id long, text string").coalesce(1)

        def size(texts: pa.Array) -> pa.Array:
            return pa.array([len(texts)] * len(texts))

        seen = [r[0] for r in rows.select(F.arrow_udf(size, "long")("text")).collect()]
    assert max(seen) * len(text) <= 2 * common.BATCH_BYTES and spark.conf.get(common.BATCH_CONF) == before
