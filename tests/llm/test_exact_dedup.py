import hashlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
from trackside.llm import exact_dedup

UP = {c: c + 32 for c in range(65, 91)}


def norm(t):
    return (t or "").translate(UP)


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    return {t: (max([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}


def test_groups_match_brute_force(docs, corpus, clashing):
    want = expected(corpus)
    for df in (docs, clashing):
        got = exact_dedup.exact_groups(df, digest_all=True).collect()
        assert len(got) == len(corpus)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
        assert Counter((r.id, r.sha) for r in got) == Counter(
            (i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in corpus)
        kept = Counter()
        for r in got:
            assert (r.keep_id, r.group_size) == by_sha[r.sha]
            kept[r.sha] += r.kept
            assert not r.kept or r.id == r.keep_id
        assert set(kept.values()) == {1}


def test_dedup_keeps_one_row_per_text_and_all_columns(docs, corpus, clashing, unsortable):
    want = expected(corpus)
    for df in (docs, clashing, unsortable):
        out = exact_dedup.exact_dedup(df)
        assert out.columns == df.columns
        got = out.collect()
        assert Counter(norm(r.text) for r in got) == Counter(dict.fromkeys(want, 1))
        assert all(r.doc_id == want[norm(r.text)][0] for r in got)


def test_empty_table(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_the_main_path_runs_no_python(docs):
    for df in (exact_dedup.exact_groups(docs, digest_all=True), exact_dedup.exact_dedup(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_registered_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op6_exact_dedup"](spark, sf)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
