import base64
import random
from collections import Counter

import tiktoken

import __spark_entry__ as entry
from trackside.llm import queries
from trackside.llm import token_counts as tc


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.VOCABULARY, "rb"))}
    return tiktoken.Encoding("test", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})


def whole(enc, text):
    return len(enc.encode_ordinary(text or ""))


def test_random_edits_equal_a_full_count():
    counter = tc.Counter(open(tc.VOCABULARY, "rb").read())
    enc, rng = encoding(), random.Random(11)
    bits = ["the ", "don't", "'", "'ll", " 12", "3", "  ", "\n", "\t \n", "é", "ß ", "!!", "??x", "a", "b c", " ", "", "日本", " "]
    for case in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60, 900])))
        tree = tc.Tree(*counter.leaves(text))
        for _ in range(12):
            a = rng.randint(-2, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 2, 5, 40, 300])
            text, pieces, chars = tc.edit_text(counter, tree, text, a, b, "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 30]))))
            want = counter.leaves(text)
            assert [x for c, _ in tree.blocks for x in c] == want[0] and [x for _, t in tree.blocks for x in t] == want[1]
            assert (tree.chars, tree.pieces, tree.tokens) == (len(text), len(want[0]), sum(want[1]))
            assert tree.tokens == whole(enc, text)


def test_an_edit_encodes_only_its_surroundings():
    counter = tc.Counter(open(tc.VOCABULARY, "rb").read())
    text = "some words in a long text " * 2000
    tree = tc.Tree(*counter.leaves(text))
    _, pieces, chars = tc.edit_text(counter, tree, text, 20000, 20004, "new")
    assert pieces < 8 and chars < 40


def test_packed_trees_round_trip():
    counter = tc.Counter(open(tc.VOCABULARY, "rb").read())
    for text in ("", "a", "word " * 700):
        tree = tc.Tree(*counter.leaves(text))
        again = tc.Tree.unpack(tree.pack())
        assert again.blocks == tree.blocks and again.tokens == tree.tokens


def test_edit_log_on_edge_rows(spark, docs, clashing, corpus, empty):
    enc = encoding()
    log = spark.createDataFrame([(i, s, 3 * s, 3 * s + 4, "xx yy" if s % 2 else None) for i in (1, 100, 401, 500) for s in (3, 1, 2)]
                                + [(403, 1, None, None, "start "), (77777, 1, 0, 0, "nobody")],
                                "id long, seq int, start long, end long, replacement string")
    for df in (docs, clashing):
        got = tc.apply_edits(tc.attach_edits(tc.build_trees(df), log)).collect()
        assert len(got) == len(corpus)
        assert Counter(r.n_tokens for r in got) == Counter(whole(enc, t) for _, t, *_ in corpus)
        assert all(r.n_tokens_after == whole(enc, r.text) for r in got)
        assert {r.n_edits for r in got if r.id in (1, 100, 401, 500)} == {3}
        assert [r.text for r in got if r.id == 403] == ["start One"]
    assert tc.build_trees(empty).count() == 0


def test_registered_query_against_full_counts(spark):
    sf, enc = "/root/testdata/sf0.001", encoding()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    edited = {}
    for r in queries.sample_edits(table).collect():
        text = r.text
        for e in r.edits:
            a, b = min(e.start, len(text)), min(max(e.end, e.start), len(text))
            text = text[:a] + e.replacement + text[b:]
        edited[r.doc_id] = text
    got = entry.queries()["op1_edit_aware_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in got} == {
        i: (whole(enc, t), whole(enc, edited[i])) for i, t in texts.items()}
    assert sum(r.n_reencoded for r in got) < 0.2 * sum(r.n_pretokens_after for r in got)


def test_frequent_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_WORDS", 10)
    counter = tc.Counter(open(tc.VOCABULARY, "rb").read())
    for i in range(100):
        counter.tokens(f" w{i}")
    assert len(counter.known) <= 10
