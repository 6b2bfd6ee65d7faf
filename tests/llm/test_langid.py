import numpy as np
import zlib
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import langid


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 20, 60):
        code = langid.codewords(n)
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert near >= max(1, code.shape[1] // 4) and len(np.unique(code, axis=0)) == n
        assert not (np.abs(code.sum(axis=0)) == n).any()


def test_letters():
    assert langid.letters_of(None) == b"" and langid.letters_of("12 34 !?\n") == b""
    assert langid.letters_of("“Été”, don’t STOP") == " été don t stop ".encode()


def test_decoding_corrects_wrong_bits():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((langid.DIMS, code.shape[1]), np.float32), np.ones(code.shape[1]))
    slots = np.unique(langid.gram_slots(b" word "))
    model.weights[slots] = code[2]
    model.weights[np.ix_(slots, [0, 3])] *= -0.2  # two bit classifiers are wrong
    lang, score, ambiguous = model.decode(b" word ")
    assert lang == "c" and 0 < score <= 1 and not ambiguous


def test_ambiguous_text_is_flagged():
    counts = np.zeros((2, langid.DIMS))
    for i, w in enumerate((b" alpha ", b" omega ")):
        counts[i] = np.bincount(langid.gram_slots(w), minlength=langid.DIMS)
    model = langid.model_from_counts(["x", "y"], counts)
    assert model.decode(b" alpha ")[0] == "x" and model.decode(b" omega ")[0] == "y"
    assert model.decode(b" zzqqkk ")[2]


def test_edge_rows(spark, docs, clashing, corpus, empty):
    train = F.col("doc_id") < 300
    model = langid.fit(docs, train=train)
    assert model.langs == ["de", "en"]
    for df in (docs, clashing):
        got = langid.predict(df, model).collect()
        assert len(got) == len(corpus)
        for r in got:
            assert 0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und")
        und = sorted(r.id for r in got if r.lang_pred == "und")
        assert und == [400, 401, 402, 406]
        kept = langid.keep_identified(df, model)
        stay = sum(not langid.rejected(model, t) for _, t, *_ in corpus)
        assert kept.columns == df.columns and kept.count() == stay <= len(corpus) - 4
    assert langid.predict(empty, model).count() == 0 and langid.keep_identified(empty, model).count() == 0
    nothing = langid.fit(empty, train=train)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.filter("lang = 'de'"), train=F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"de", "und"}


def plain_counts(rows):
    """Byte n-grams of each language, counted one by one."""
    out = {}
    for text, lang in rows:
        b = langid.letters_of(text)
        mine = out.setdefault(lang, np.zeros(langid.DIMS))
        for n in langid.ORDERS:
            for i in range(len(b) - n + 1):
                key = (int.from_bytes(b[i:i + n], "big") + n) % 2 ** 32
                mine[key * 2654435761 % 2 ** 32 >> 18] += 1
    return out


def plain_decode(langs, p, code, text):
    """Language, score and ambiguity recomputed with loops."""
    b = langid.letters_of(text)
    if not b:
        return "und", 0.0, True
    slots = [(int.from_bytes(b[i:i + n], "big") + n) % 2 ** 32 * 2654435761 % 2 ** 32 >> 18
             for n in langid.ORDERS for i in range(len(b) - n + 1)]
    margins, trust = [], []
    for j in range(code.shape[1]):
        side = [np.log(np.mean([p[i] for i in range(len(langs)) if code[i, j] == s], axis=0)) for s in (1, -1)]
        w = side[0] - side[1]
        margins.append(sum(w[s] for s in slots) / max(len(slots), 1))
        trust.append(max(min(code[i, j] * float(p[i] @ w) for i in range(len(langs))), 0.05))
    trust = np.array(trust) / np.mean(trust)
    loss = [sum(t * np.exp(-langid.SHARPNESS * min(max(c * m, -2), 2)) for t, c, m in zip(trust, code[i], margins))
            for i in range(len(langs))]
    best = sorted(range(len(langs)), key=lambda i: loss[i])
    near = [np.exp(-langid.SHARPNESS * (x - loss[best[0]]) / sum(trust)) for x in loss]
    return langs[best[0]], near[best[0]] / sum(near), (loss[best[1]] - loss[best[0]]) / loss[best[1]] < langid.AMBIGUOUS_MARGIN


def test_matches_a_plain_recomputation(spark, docs, corpus):
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    model = langid.fit(docs, train=train)
    counts = plain_counts([(t, lang) for i, t, lang, _ in corpus if (i or 0) % 3 != 0 and lang is not None])
    langs = sorted(counts)
    c = np.array([counts[x] for x in langs])
    p = (c + langid.SMOOTHING) / (c.sum(axis=1, keepdims=True) + langid.SMOOTHING * langid.DIMS)
    assert model.langs == langs
    got = {(r.id, r.lang_pred, round(r.score, 4), r.ambiguous) for r in langid.predict(docs, model).collect()}
    want = {(i, *plain_decode(langs, p, model.code, t)) for i, t, *_ in corpus if t is None or len(t) < 3000}
    for i, lang, score, ambiguous in want:
        assert any(g[0] == i and g[1] == lang and abs(g[2] - score) < 1e-3 and g[3] == ambiguous for g in got), (i, lang, score)


def test_long_texts_decode_alike_in_little_memory():
    rng = np.random.default_rng(1)
    model = langid.model_from_counts(list("abcdefgh"), rng.integers(0, 50, (8, langid.DIMS)).astype(float))
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(6000)).encode()
    slots = langid.gram_slots(text)
    assert len(slots) > langid.DIMS
    margin = model.weights[slots].sum(axis=0, dtype=np.float64) / len(slots)
    loss = (model.trust * np.exp(-langid.SHARPNESS * np.clip(model.code * margin, -2, 2))).sum(axis=1)
    assert model.decode(text)[0] == model.langs[int(np.argmin(loss))]
    import tracemalloc
    tracemalloc.start()
    model.decode(text * 25)  # a million bytes
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_mixed_texts_are_rejected_short_ones_stay(spark):
    counts = np.zeros((2, langid.DIMS))
    for i, w in enumerate((b" alpha beta ", b" omega zulu ")):
        counts[i] = np.bincount(langid.gram_slots(w), minlength=langid.DIMS)
    model = langid.model_from_counts(["x", "y"], counts)
    rows = [(1, "alpha beta " * 40), (2, "alpha beta omega zulu " * 40), (3, "qqq kkk " * 40), (4, "qqq"), (5, "12 %"), (6, None)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_training_sample_is_bounded(docs):
    few = langid._training_rows(docs, "doc_id", "text", "lang", F.lit(True), 5).groupBy("lang").count().collect()
    assert all(r["count"] <= 15 for r in few)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op9_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
