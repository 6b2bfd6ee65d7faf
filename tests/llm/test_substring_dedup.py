import hashlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from trackside.llm import substring_dedup as sd


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = b" ".join(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[b" ".join(w[k:k + window])] < i:
                    gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window", [50, 8])
def test_matches_brute_force(docs, clashing, corpus, window):
    want = brute(corpus, window)
    for df in (docs, clashing):
        got = sd.remove_repeats(df, window=window, buckets=7).collect()
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_hot_grams_and_small_messages_change_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(sd, "MAX_RUN", 9)
    norms = [sd.normal_text(t) for _, t, *_ in corpus if len((t or "").split()) >= 50]
    for hot in (np.zeros(sd.SLOTS, bool), np.ones(sd.SLOTS, bool), np.arange(sd.SLOTS) % 2 == 0):
        begin, length, _ = sd.super_kmers(sd._Words(norms), hot, 50)
        assert length.max() <= 9
        # every window of every text is in exactly one super-k-mer
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(begin, length)])
        words = sd._Words(norms)
        inside = np.flatnonzero(words.text_of[: len(words.text_of) - 49] == words.text_of[49:])
        assert np.array_equal(np.sort(covered), inside)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(sd.K, "mix", lambda x: x & sd.K.U64(3))  # nearly every window collides
    a, b = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    strings = [" ".join(x).encode() for x in (a, b, a[5:] + b[:5])]
    ids = np.array([3, 1, 9])
    got = sd.covered_ranges(strings, ids, np.zeros(3, np.int64), np.array([0, 0, 100]), 50)
    assert [x.tolist() for x in got] == [[9], [0], [100], [155]]


def test_empty_table(empty):
    assert sd.remove_repeats(empty).count() == 0


def test_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.queries()["op3_substring_dedup"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 50)
