import itertools
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import simhash
from trackside.llm.components import connected_components


def brute_fp(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def expected(rows):
    pairs = [(i, brute_fp(t)) for i, t, *_ in rows]
    comp = brute_components({f for _, f in pairs})
    low = {}
    for i, f in pairs:
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], i), i)
    return Counter((i, f, low.get(comp[f])) for i, f in pairs)


def test_groups_match_brute_force(docs, corpus, clashing):
    want = expected(corpus)
    for df in (docs, clashing):
        got = Counter((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(df).collect())
        assert got == want


def test_long_text_counts_beyond_a_byte():
    assert simhash.fingerprint(simhash.shingle_hashes("a b c d " * 500, 3)) == brute_fp("a b c d " * 500)


def test_links_are_complete_on_dense_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 6).tolist() + [0, -1]
    fps = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit if bit < 63 else -(1 << 63)
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (0, 1, 2, 3):
        got = {(r.a, r.b) for r in simhash.hamming_links(df, bits).collect()}
        want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) % (1 << 64)).bit_count() <= bits}
        assert got == want


def test_components_of_chains_stars_and_self_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5), (1, 7), (7, 1), (1, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161))
    assert all(got[i] == 1 for i in (7, *range(200, 260)))
    assert 5 not in got


def survivors(rows):
    """(id, fingerprint) of the rows that stay: those whose id names their component, one row of a component without ids."""
    stay, unnamed, comp = Counter(), set(), brute_components({brute_fp(t) for _, t, *_ in rows})
    for (i, f, c), n in expected(rows).items():
        if i is not None and i == c:
            stay[i, f] += n
        elif c is None and comp[f] not in unnamed:
            unnamed.add(comp[f])
            stay[None, None] += 1
    return stay


def test_dedup_keeps_the_smallest_id(docs, corpus, clashing, unsortable):
    for df in (docs, clashing, unsortable):
        out = simhash.simhash_dedup(df)
        assert out.columns == df.columns
        assert Counter((r.doc_id, None if r.doc_id is None else brute_fp(r.text)) for r in out.collect()) == survivors(corpus)


def test_dedup_judges_each_row_by_its_own_component(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(1, text("a")), (None, text("a")), (None, text("b")),  # the null id loses in a, not in b
            (5, text("c")), (7, text("c")), (7, text("d")), (8, text("d")),  # 7 loses in c, names d
            (None, text("e")), (None, text("e")), (None, text("e").upper()),  # no id at all: one row
            (9, text("f")), (9, text("f"))]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.text.lower()) for r in got.collect()) == Counter(
        [(1, text("a")), (None, text("b")), (5, text("c")), (7, text("d")), (None, text("e")), (9, text("f")), (9, text("f"))])


def test_empty_table(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.simhash_dedup(empty).count() == 0


def test_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op4_simhash_near_dedup"](spark, sf)
    assert got.schema["component_id"].dataType.simpleString() == "bigint"
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got.collect()) == expected(rows)
    assert all(len(r.fingerprint) == 16 for r in got.select(F.col("fingerprint")).limit(3).collect())
