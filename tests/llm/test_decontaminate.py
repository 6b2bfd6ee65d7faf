import random
import re
from collections import Counter

import __spark_entry__ as entry
from trackside.llm import decontaminate as dc



def words(t):
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, items):
    out = Counter()
    own = [(i, shingles(b)) for i, b in items]
    for d, t, *_ in rows:
        have = shingles(t)
        for i, want in own:
            n = len(want & have)
            if want and 5 * n >= 4 * len(want):
                out[(d, i, n, len(want))] += 1
    return out


def make_items(corpus):
    rng = random.Random(3)
    long = next(t for i, t, *_ in corpus if i == 500).split()
    items = [(0, " ".join(long[4000:4030])), (1, " ".join(long[50:58]).upper()), (2, "one, TWO!"), (3, None), (4, ""),
             (5, ' '.join(f'x{rng.random()}' for _ in range(40))), (6, "one"), (7, " ".join(long[100:140] + ["other"] * 3 + long[140:160])),
             (8, " ".join(long[300:340]) + " " + " ".join(f"odd{i}" for i in range(6))),
             (9, " ".join(long[600:640]) + " " + " ".join(f"odd{i}" for i in range(30))), (0, " ".join(long[4000:4030]))]
    base = next(t for i, t, *_ in corpus if i == 100).split()
    return items + [(20 + k, " ".join(base[9 * k:9 * k + 12 + k])) for k in range(12)] + [(None, " ".join(base[40:70]))]


def test_matches_brute_force(spark, docs, clashing, corpus, monkeypatch):
    items = make_items(corpus)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(corpus, items)
    assert len(want) > 20
    got = lambda df: Counter((r.doc_id, r.item_id, r.n_shared, r.n_item_shingles)
                             for r in dc.find_contaminated(df, table).collect())
    assert got(docs) == want
    assert got(clashing) == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 900)  # several blocks of benchmark items
    assert got(docs) == want


def test_filter_judges_each_row(spark, docs, clashing, corpus):
    items = make_items(corpus)
    table = spark.createDataFrame(items, "item_id long, text string")
    clean = Counter((d, t) for d, t, *_ in corpus if not brute([(d, t)], items))
    for df in (docs, clashing):
        out = dc.decontaminate(df, table)
        assert out.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == clean


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert dc.find_contaminated(docs, none).count() == 0
    assert dc.find_contaminated(empty, some).count() == 0
    assert dc.decontaminate(docs, none).count() == docs.count()
    assert dc.decontaminate(empty, some).count() == 0


def test_threshold_keeps_enough_hashes():
    rng = random.Random(1)
    for q in (5, 6, 9, 23, 80):
        text = " ".join(f"w{rng.random()}" for _ in range(q)).replace("0.", "")
        sig = dc.Signatures([(1, text)], 0.8)
        n = len(sig.items[0][1])
        assert [len(h) for h, _ in sig.parts] == [n - -(-4 * n // 5) + 1]


def test_items_of_other_sizes_have_other_tables():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(q)) for q in (6, 6, 40, 300)]
    sig = dc.Signatures(list(enumerate(texts)), 0.8)
    assert [sorted(set(owner.tolist())) for _, owner in sig.parts] == [[0, 1], [2], [3]]
    assert all((h[1:] >= h[:-1]).all() for h, _ in sig.parts)
    g, at = dc._doc_hashes(b"\n".join(dc.normal_words(t) for t in ["x y z " + texts[3] + " end", "none of it at all here", texts[0]]) + b"\n")
    assert sig.candidates(g, at) == {(0, 3), (2, 0)}


def test_registered_query_finds_the_planted_passages(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = entry.queries()["op8_benchmark_decontamination"](spark, sf).collect()
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item_shingles) for r in got) == brute(rows, items)
