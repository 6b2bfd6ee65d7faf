import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import suffix_tree as st

END = object()


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def brute(rows, is_train):
    """Scores by plain dictionaries, by the definitions of the module's docstring: any length, no limit."""
    train = [tokens(t) for i, t, *_ in rows if is_train(i)]
    every = [tokens(t) for i, t, *_ in rows]
    uni = Counter(x for d in train for x in d)
    n, v = sum(uni.values()), len(uni)
    size, nxt, keep = {(): n}, {(): uni}, {()}
    tried = {(w,) for w, c in uni.items() if w is not END and c >= st.MIN_COUNT}
    size |= {(w,): c for w, c in uni.items()}
    k = 1
    while tried:
        for s in tried:
            nxt[s] = Counter()
        for d in train:
            for at in range(k, len(d)):
                if tuple(d[at - k:at]) in tried:
                    nxt[tuple(d[at - k:at])][d[at]] += 1
        for s in tried:
            up, back, gain = s[1:], st.TEST_WEIGHT * size[s], 0.0
            for x, own in nxt[s].items():
                p = nxt[up][x] / size[up]
                gain += own * (math.log(own - 1 + back * p) - math.log(p))
            assert sum(nxt[s].values()) == size[s]
            if gain / size[s] - math.log(size[s] - 1 + back) >= st.MIN_GAIN:
                keep.add(s)
            size |= {(*s, x): c for x, c in nxt[s].items()}
        longer = {(*s, x) for s in tried for x, c in nxt[s].items() if x is not END and c >= st.MIN_COUNT}
        tried = {s for s in longer if s[1:] in tried and len(nxt[s[1:]]) > 1 and (k < st.FREE_WORDS or s[1:] in keep)}
        k += 1
    out = []
    for (i, *_), d in zip(rows, every):
        base, score = 0.0, 0.0
        for at, x in enumerate(d):
            p = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for back in range(1, at + 1):
                s = tuple(d[at - back:at])
                if s not in nxt:
                    break
                if s in keep:
                    p = (nxt[s][x] + len(nxt[s]) * p) / (size[s] + len(nxt[s]))
            score += math.log10(p)
        out.append((i, len(d), sum(uni[x] > 0 for x in d), n, base, score))
    return out, max(map(len, keep))


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:4]) == tuple(w[:4])
        assert math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-7, abs_tol=1e-7)


def is_train(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def run(df, **kw):
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return [tuple(r[c] for c in ("id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
            for r in st.score_documents(df, train=fold != 1, **kw).collect()]


def test_matches_brute_force(docs, clashing, corpus, monkeypatch):
    want, depth = brute(corpus, is_train)
    assert depth > 2
    close(run(docs), want)
    close(run(clashing, buckets=5), want)
    monkeypatch.setattr(st, "CHUNK_BYTES", 5000)  # many chunks
    close(run(docs, buckets=3), want)


def test_hot_contexts_and_long_contexts(spark):
    """One word tells nothing about the next, two do; one word makes up most of the table."""
    middle = "m"
    texts = [f"u{i} {a} {middle} {b} z" for i in range(30) for a, b in (("a", "x"), ("b", "y"))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot " * 700) for i in range(4)]
    want, depth = brute(rows, lambda i: True)
    assert depth >= 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for buckets in (1, 40):
        got = st.score_documents(df, train=F.lit(True), buckets=buckets).collect()
        close([tuple(r[c] for c in ("id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got], want)


def test_a_larger_copy_of_a_table_has_the_contexts_of_the_small_one(spark):
    """Counts decide, not shares: unrelated text does not take a context away."""
    rows = [(i, "rare words come together") for i in range(2)]
    more = [(10 + i, f"w{i} v{i} " * 2000) for i in range(20)]
    gains = []
    for table in (rows, rows + more):
        got = st.score_documents(spark.createDataFrame(table, "doc_id long, text string"), train=F.lit(True)).collect()
        gains.append(next(r.score - r.base_score for r in got if r.id == 0))
    assert gains[0] > 0.5 and gains[1] > gains[0]


def test_ids_of_any_type(spark, docs, corpus):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc "), F.col("doc_id")))
    got = st.score_documents(named, train=F.lit(True)).collect()
    assert Counter(r.id for r in got) == Counter(None if i is None else f"doc {i}" for i, *_ in corpus)


def test_empty_table_and_no_training(docs, corpus, empty):
    assert run(empty) == []
    got = st.score_documents(docs, train=F.lit(False)).collect()
    assert len(got) == len(corpus) and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in got)


def test_held_out_documents_score_better_than_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op5_suffix_tree_scores"](spark, sf).collect()
    assert all(r.held_out != is_train(r.doc_id) for r in got) and len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.98
    train = Counter(x for i, t in rows if is_train(i) for x in tokens(t))
    n, v = sum(train.values()), len(train)
    for r in got[:50]:
        t = tokens(dict(rows)[r.doc_id])
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(train[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_later_levels_keep_only_the_words_they_need(spark, monkeypatch):
    """Words that no open token needs pack to nothing, so that the tables of deep levels follow the open tokens."""
    rng, rows = random.Random(1), []
    for i in range(12):
        run = ["a", "b", "c"]
        for _ in range(120):  # three words tell the next one, mostly
            run.append("abcdefgh"[zlib.crc32(" ".join(run[-3:]).encode()) % 8] if rng.random() < 0.8 else rng.choice("abcdefgh"))
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(3000)) + " " + " ".join(run)))
    sizes, write = {}, st.Levels.write

    def watch(self, df, table, by=None):
        out = write(self, df, table, by)
        if table.startswith("chunks"):
            sizes[table] = out.agg(F.sum(F.length("state")), F.sum("open")).first()
        return out

    monkeypatch.setattr(st.Levels, "write", watch)
    st.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), train=F.lit(True)).count()
    (first, _), (last, still) = sizes["chunks_1"], sizes["chunks_3"]
    assert 0 < still < 2000 and last < first / 3


def chunk_of(n_words, n_tokens, seed):
    """A chunk as it is before its second level, with words as frequent as in a text."""
    rng = np.random.default_rng(seed)
    words = (n_words * rng.random(n_tokens) ** 4).astype(np.int64)
    pos, per = np.arange(2, n_tokens), rng.integers(2, 40, n_tokens - 2)
    zero, totals = np.zeros(1), np.sort(rng.integers(50, 3_000_000 // n_words, n_words))[::-1].astype(st.K.U64)
    kinds = rng.integers(1, 50, n_words).astype(st.K.U64)
    return st.Chunk(np.array([n_tokens]), np.array([1]), zero, zero, zero, words, np.arange(n_words, dtype=st.K.U64), totals,
                    pos, per.astype(st.K.U64), per[::-1].astype(st.K.U64), kinds, np.zeros(0))


def test_messages_do_not_grow_with_the_number_of_buckets():
    """What a chunk asks takes about as many bytes over many buckets as over few, at every kind of key, and reads back whole."""
    s = chunk_of(3000, 200_000, 7)
    for level, narrow in ((1, True), (2, True), (2, False)):
        sizes = []
        for buckets in (2, 16):
            model = st.Model(3_000_000, 3000, buckets, 30_000.0, narrow)
            asked, found = st.Asked(s, level, model), []
            messages = list(asked.messages())
            for b, m in messages:
                key, count, up, row, x, after, n = st._open(m, level, b, model)
                found += zip(key[row].tolist(), up[row].tolist(), x.tolist(), after.tolist(), n.tolist(), count[row].tolist())
            assert found == list(zip(*(a.tolist() for a in (asked.key, asked.up, asked.x, asked.after, asked.n, asked.hot_count))))
            sizes.append(sum(len(m) for _, m in messages))
        assert sizes[1] < 1.15 * sizes[0], (level, narrow, sizes)


def test_numbers_of_any_size_read_back():
    values = np.array([0, 1, 127, 128, 129, 16511, 16512, 16513, 4145279, 4145280, 4145281, 1 << 32, (1 << 63) + 5], dtype=np.uint64)
    values = np.concatenate([values, values[::-1]])
    assert (st._whole(*st._short(values)) == values).all() and len(st._whole(*st._short(values[:0]))) == 0
    signed = values[values < 1 << 61]
    assert (st._walk(st._steps(signed)) == signed).all()
