"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one linear classifier per codeword bit
decides from hashed byte n-grams of the letters which side a text is on. Decoding
takes the codeword of least loss, each bit weighted by how well it separates its
two sides, so a few wrong bits are corrected. Texts whose two nearest codewords
are almost equally far are flagged as ambiguous.

The bit classifiers are multinomial naive Bayes on n-gram counts, so training is
one grouped count: at most ``MAX_TRAIN_PER_LANG`` labelled rows per language, taken
by smallest id hash, are read (a documented bound; prediction reads every row).

Defined results
* A null text or one without any letter is ``und`` with score 0. Letters are
  ASCII letters and non-ASCII alphabetic characters.
* Without any labelled row every text is ``und``; with one language all texts
  with letters get it, score 1. Null labels are not learned. Repeated rows are
  scored alike; empty tables give empty results; extra columns are ignored by
  ``predict`` and carried unchanged by ``keep_identified``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UND = "und"
DIMS = 1 << 14
ORDERS = (2, 3, 4)
MAX_TRAIN_PER_LANG = 20_000
SMOOTHING = 0.5
EXHAUSTIVE_UP_TO = 6
CODE_SEED = 9
# a bit's evidence: mean log-odds per n-gram, scaled before the loss
SHARPNESS = 4.0
AMBIGUOUS_MARGIN = 0.15
AMBIGUOUS_LETTERS = 200
# bytes that are not letters become one separator; letters are lower-cased before
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters_of(text: str | None) -> bytes:
    """Lower-cased letters of a text in UTF-8, words separated by one space, padded."""
    if not text:
        return b""
    low = text.lower()
    if not low.isascii():  # non-ASCII marks such as quotes or dashes are not letters
        odd = {c for c in set(low) if ord(c) >= 128 and not c.isalpha()}
        if odd:
            low = low.translate({ord(c): " " for c in odd})
    words = low.encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def gram_slots(letters: bytes) -> np.ndarray:
    """Hashed slots of all byte n-grams."""
    b = np.frombuffer(letters, dtype=np.uint8).astype(np.uint32)
    out, key = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        key = (key[:-1] << np.uint32(8)) | b[n - 1:]
        if n in ORDERS:
            out.append(((key + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 14))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1/+1: all two-sided splits for few classes, else a seeded dense code."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE_UP_TO:
        cols = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(cols, dtype=np.int8).T
    rng, bits, best = np.random.default_rng(CODE_SEED), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):  # the draw whose nearest two codewords are farthest apart
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        near = ((code[:, None] != code[None]).sum(axis=2) + np.eye(n, dtype=int) * bits).min()
        if best is None or near > best[0]:
            best = (near, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # (langs, bits) -1/+1
    weights: np.ndarray   # (DIMS, bits) log-odds
    trust: np.ndarray     # (bits,) weight of each bit in the decoding

    def decode(self, letters: bytes) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of one text."""
        if not letters or not self.langs:
            return UND, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        slots = gram_slots(letters)
        if len(slots) < DIMS:
            margin = self.weights[slots].sum(axis=0, dtype=np.float64)
        else:  # a long text: its slot counts, not a row of weights for each of its n-grams
            margin = np.bincount(slots, minlength=DIMS) @ self.weights.astype(np.float64)
        margin /= max(len(slots), 1)
        # loss-weighted decoding: exponential loss of each codeword bit against its margin
        loss = (self.trust * np.exp(-SHARPNESS * np.clip(self.code * margin, -2, 2))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        near = np.exp(-SHARPNESS * (loss - loss[order[0]]) / self.trust.sum())
        gap = (loss[order[1]] - loss[order[0]]) / loss[order[1]]
        return self.langs[order[0]], float(near[order[0]] / near.sum()), bool(gap < AMBIGUOUS_MARGIN)


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column,
                   per_lang: int) -> DataFrame:
    """Labelled training rows, at most about ``per_lang`` of a language, by smallest id hash."""
    labelled = docs.filter(train & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(CODE_SEED), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(1.0)
    for lang, n in sorted(sizes.items()):
        if n > per_lang:
            share = F.when(F.col("lang") == lang, F.lit(per_lang / n)).otherwise(share)
    return labelled.filter(draw < share)


def fit(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = MAX_TRAIN_PER_LANG) -> Model:
    """Learn the bit classifiers from the labelled rows for which ``train`` holds."""
    rows = _training_rows(docs, id_col, text_col, lang_col, train, per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums.setdefault(lang, np.zeros(DIMS, dtype=np.int64))
                sums[lang] += np.bincount(gram_slots(letters_of(text)), minlength=DIMS)
        for lang, v in sorted(sums.items()):
            slots = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(v[slots])],
                names=["lang", "slot", "n"])

    # languages x DIMS rows at most, whatever the size of the corpus
    got = (rows.select("lang", "text").mapInArrow(count, "lang string, slot int, n long")
           .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(langs), DIMS))
    if langs:
        row = {x: i for i, x in enumerate(langs)}
        counts[got["lang"].map(row).to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    return model_from_counts(langs, counts)


def model_from_counts(langs: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((DIMS, 1), np.float32), np.ones(1))
    # each language counts alike, so a frequent language does not own its side of a bit
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * DIMS)
    weights, trust = np.zeros((DIMS, code.shape[1])), np.zeros(code.shape[1])
    for j, bits in enumerate(code.T):
        one, two = p[bits > 0].mean(axis=0), p[bits < 0].mean(axis=0)
        weights[:, j] = np.log(one) - np.log(two)
        # how far the expected margins of the worst-placed languages lie on the right side
        trust[j] = max((bits * (p @ weights[:, j])).min(), 0.05)
    return Model(langs, code, weights.astype(np.float32), trust / trust.mean())


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row, from its whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x bits floats
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.decode(letters_of(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        task, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def rejected(model: Model, text: str | None, min_letters: int = AMBIGUOUS_LETTERS) -> bool:
    """No language, or ambiguous in spite of ``min_letters`` bytes of letters (languages mixed, or none of those learned).

    Short ambiguous texts are not rejected: too little evidence is no fault of theirs."""
    letters = letters_of(text)
    lang, _, ambiguous = model.decode(letters)
    return lang == UND or (ambiguous and len(letters) >= min_letters)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text",
                    min_letters: int = AMBIGUOUS_LETTERS) -> DataFrame:
    """``docs`` without the rows that ``rejected`` turns down."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> pa.Array:
        return pa.array([not rejected(sent.value, t.as_py(), min_letters) for t in texts], pa.bool_())

    return docs.filter(F.arrow_udf(keep, "boolean")(F.col(text_col).cast("string")))
