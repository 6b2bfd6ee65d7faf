import math
from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import quality


def run(docs, labels, **kw):
    return quality.quality_scores(docs, labels, train=F.lit(True), host=F.col("source"), path=F.col("lang"), **kw)


def test_edge_rows_and_clashing_names(spark, docs, clashing, corpus, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (7, None), (8, 0), (8, 1)],
                                   "doc_id long, quality int")
    for df in (docs, clashing):
        got = run(df, labels).collect()
        assert len(got) == len(corpus)
        assert all(0 < r.quality < 1 and 0 < r.path_prior < 1 and r.kept == (r.quality >= 0.5) for r in got)
    assert run(empty, labels).count() == 0


def test_without_labels_there_is_no_evidence(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.evidence, 9) for r in run(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {round(r.evidence, 9) for r in run(docs, ones).collect()} == {0.0}


def test_posteriors_match_a_direct_computation(spark):
    rows = [(i, f"h{i % 4}" if i % 5 else None, f"p{i % 3}", 0.1 + 0.8 * ((i * 37 % 11) / 11 * (0.3 if i % 4 else 1)), 0.2 * (i % 7 - 3))
            for i in range(200)] + [(999, "lone", "only", 0.9, 1.0)]
    got = {r.id: r for r in quality.hierarchical_scores(
        spark.createDataFrame(rows, "id long, host string, path string, v double, log_factor double")).collect()}
    host, path = defaultdict(list), defaultdict(list)
    for _, h, p, v, _ in rows:
        host[h].append(v)
        path[h, p].append(v)
    total = len(rows)
    mu = (sum(r[3] for r in rows) + 1) / (total + 2)
    spread = sum(len(v) * (sum(v) / len(v) - mu) ** 2 for v in host.values())
    m_host = quality._strength(spread, (len(host) - 1) * mu * (1 - mu),
                               total - sum(len(v) ** 2 for v in host.values()) / total, mu * (1 - mu))
    mean = {h: sum(v) / len(v) for h, v in host.items()}
    own = sum(len(v) * (sum(v) / len(v) - mean[h]) ** 2 for (h, _), v in path.items())
    kinds = {h: [v for (g, _), v in path.items() if g == h] for h in host}
    m_path = quality._strength(own, sum((len(kinds[h]) - 1) * mean[h] * (1 - mean[h]) for h in host),
                               sum(len(host[h]) - sum(len(v) ** 2 for v in kinds[h]) / len(host[h]) for h in host),
                               sum(len(host[h]) * mean[h] * (1 - mean[h]) for h in host) / total)
    for i, h, p, v, f in rows:
        hp = (sum(host[h]) - v + m_host * mu) / (len(host[h]) - 1 + m_host)
        pp = (sum(path[h, p]) - v + m_path * hp) / (len(path[h, p]) - 1 + m_path)
        assert math.isclose(got[i].host_prior, hp, rel_tol=1e-9) and math.isclose(got[i].path_prior, pp, rel_tol=1e-9)
        assert math.isclose(got[i].quality, 1 / (1 + math.exp(-(math.log(pp / (1 - pp)) + f))), rel_tol=1e-9)
    assert math.isclose(got[999].path_prior, mu, rel_tol=1e-9)  # a lone document's site says nothing about it


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = entry.queries()["op10_quality_classifier"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.kept == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.95
    assert sum(r.kept for r in held if truth[r.doc_id] == 1) / sum(truth[r.doc_id] for r in held) > 0.97
