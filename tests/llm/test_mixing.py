import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackside.llm import mixing


def rates(rows, alpha=0.5, volume=1.0, weights=None):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(t or "")
    w = {s: n ** alpha if weights is None else weights.get(s, 0.0) for s, n in size.items()}
    tw, tc = sum(w.values()), sum(size.values())
    return {s: 1.0 if n == 0 else (w[s] / tw * tc * volume / n if tw else 0.0) for s, n in size.items()}


def copies(doc_id, rate, text="", seed=42):
    key = doc_id if doc_id is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
    draws, total = math.ceil(rate / mixing.RATE_STEP), 0
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{j}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = c = math.exp(-rate / draws)
        k = 0
        while c <= u:
            k += 1
            p *= rate / draws / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("kw", [{}, {"alpha": 1.0, "volume": 3.0}, {"weights": {"a": 1.0, "long": 0.01, "none": 9.0}},
                                {"weights": {"c": 1.0}, "volume": 2.0}])
def test_matches_brute_force(docs, clashing, corpus, kw):
    rate = rates(corpus, **kw)
    want = Counter()
    for i, t, _, s in corpus:
        for k in range(copies(i, rate[s], t)):
            want[(i, t, s, k + 1)] += 1
    for df in (docs, clashing):
        got = mixing.mix_sources(df, **kw).collect()
        assert Counter((r.doc_id, r.text, r.source, r.copy_no) for r in got) == want
        assert all(math.isclose(r.rate, rate[r.source], rel_tol=1e-12) for r in got)


def test_draws_follow_the_poisson_distribution(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text"))
    for rate in (0.3, 2.0, 40.0):
        r = spark.createDataFrame([("s", 1, rate)], "source string, chars long, rate double")
        m, v = mixing.poisson_copies(ids, r).agg(F.avg("n_copies"), F.var_samp("n_copies")).first()
        assert abs(m - rate) < 4 * math.sqrt(rate / 20000) and abs(v / rate - 1) < 0.06


def test_order_is_global_and_repeatable(docs):
    a = [r.shuffle_key for r in mixing.mix_sources(docs).collect()]
    b = [r.shuffle_key for r in mixing.mix_sources(docs.repartition(3)).collect()]
    assert sorted(a) == sorted(b)


def test_rows_without_id_draw_one_by_one(spark):
    df = spark.createDataFrame([(None, f"text {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, volume=2.0).collect()
    per_text = Counter(r.text for r in got)
    assert len({per_text[f"text {i}"] for i in range(2000)}) > 4 and abs(len(got) / 2000 - 2) < 0.15
    assert len({r.shuffle_key for r in got}) == len(got)


def test_empty_table(empty):
    assert mixing.mix_sources(empty).count() == 0
