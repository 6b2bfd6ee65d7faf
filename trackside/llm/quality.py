"""Quality scores by hierarchical empirical Bayes.

A logistic classifier on text features gives each document's own evidence (a log
Bayes factor). Hosts and paths get Beta posteriors from the evidence of all their
documents: a path is shrunk towards its host and a host towards the global mean,
with strengths estimated by moments from the grouped counts, so sparse sites stay
near their priors. A document's score is its path's posterior, without the document
itself, updated by its own evidence.

The classifier is fitted on at most ``MAX_TRAIN_PER_CLASS`` labelled rows of each
class, by smallest id hash (a documented bound); all counts cover all documents.

Defined results
* A null text is empty and has all features 0. Null hosts and paths are sites of
  their own. Null labels are ignored; a document labelled twice takes the mean
  (good from one half on). Without labels of both classes there is no evidence:
  every document gets its site's posterior.
* Repeated rows are documents of their own with equal scores. Empty tables give
  an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import stored

MAX_TRAIN_PER_CLASS = 10_000
KEEP_FROM = 0.5
_SYMBOLS = b"#$%&*@^~|\\<>{}[]=+_/"
_LOUD = b"!?"
# byte classes: lower, upper, digit, space, newline, symbol, loud, other punctuation, non-ASCII
_CLASS = np.full(256, 7, dtype=np.uint8)
for _i in range(256):
    if 97 <= _i <= 122:
        _CLASS[_i] = 0
    elif 65 <= _i <= 90:
        _CLASS[_i] = 1
    elif 48 <= _i <= 57:
        _CLASS[_i] = 2
    elif _i == 10:
        _CLASS[_i] = 4
    elif _i in b"\x09\x0b\x0c\x0d\x20":
        _CLASS[_i] = 3
    elif _i in _SYMBOLS:
        _CLASS[_i] = 5
    elif _i in _LOUD:
        _CLASS[_i] = 6
    elif _i >= 128:
        _CLASS[_i] = 8
FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "loud", "punctuation", "non_ascii", "newlines",
            "distinct_words", "word_reuse", "repeated_lines", "repeated_line_chars", "longest_line", "long_words", "log_lines"]


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=9).astype(float)
    body = max(len(raw) - n[3] - n[4], 1.0)
    letters = max(n[0] + n[1] + n[8], 1.0)
    kinds = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_kinds = set(lines)
    chars = sum(map(len, lines))
    long = sum(1 for w in kinds if len(w) > 24)
    return [float(np.log1p(len(words))), body / len(words), n[1] / letters, n[2] / body, n[5] / body, n[6] / body,
            n[7] / body, n[8] / body, n[4] / len(words), len(kinds) / len(words),
            float(np.log(len(words) / len(kinds))), 1 - len(line_kinds) / len(lines),
            1 - sum(map(len, line_kinds)) / chars, float(np.log1p(max(map(len, lines)))), long / len(kinds),
            float(np.log1p(len(lines)))]


def document_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      host: Column, path: Column) -> DataFrame:
    """(id, host, path, x): the features of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.list_(pa.float64()))],
                                             names=["id", "host", "path", "x"])

    return docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       F.col(text_col).cast("string").alias("t")).mapInArrow(
        task, f"id {kind}, host string, path string, x array<double>")


@dataclass
class Evidence:
    """Weights of the document classifier; ``base`` is the training share of good documents."""
    weights: list[float]
    intercept: float
    base: float

    def log_factor(self, x: Column) -> Column:
        """log P(features | good) - log P(features | bad), bounded to +-8."""
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in self.weights]), lambda a, b: a * b),
                          F.lit(0.0), lambda acc, v: acc + v)
        prior = float(np.log(self.base / (1 - self.base)))
        return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), dot + F.lit(self.intercept - prior)))


def fit_evidence(features: DataFrame, labels: DataFrame, *, train: Column, id_col: str = "doc_id",
                 label_col: str = "quality", per_class: int = MAX_TRAIN_PER_CLASS) -> Evidence:
    """Logistic regression on a bounded sample of labelled rows; ``train`` is a condition on ``id``."""
    y = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
         .agg((F.avg(label_col) >= 0.5).cast("double").alias("y")))
    rows = features.filter(train).join(y, "id").select("id", "x", "y")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = sizes.get(1.0, 0), sizes.get(0.0, 0)
    base = (good + 1) / (good + bad + 2)
    if not good or not bad:
        return Evidence([0.0] * len(FEATURES), float(np.log(base / (1 - base))), base)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    draw = F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("y") > 0, F.lit(min(1.0, per_class / good))).otherwise(F.lit(min(1.0, per_class / bad)))
    # sampled rows count for the rows they stand for, so that the base rate stays
    sample = rows.filter(draw < share).select(array_to_vector("x").alias("features"), F.col("y").alias("label"),
                                              (F.lit(1.0) / share).alias("w"))
    model = LogisticRegression(maxIter=40, regParam=1e-4, weightCol="w").fit(sample)
    return Evidence(model.coefficients.toArray().tolist(), float(model.intercept), base)


def _strength(between: float, within: float, scale: float, mean_var: float) -> float:
    """Beta prior strength from moments: spread between sites beyond what sampling explains."""
    if scale <= 0 or mean_var <= 0:
        return 1e6
    tau = max((between - within) / scale, 0.0)
    rho = min(max(tau / mean_var, 1e-6), 0.5)
    return 1 / rho - 1


def hierarchical_scores(rows: DataFrame) -> DataFrame:
    """(id, host, path, v, log_factor) -> scores; ``v`` is a document's own evidence as a number in [0, 1]."""
    path = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("np"), F.sum("v").alias("sp"))
    path = stored(path, "quality-paths")
    host = stored(path.groupBy("host").agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"),
                                           F.sum(F.col("np") * F.col("np").cast("double")).alias("np2"),
                                           F.count(F.lit(1)).alias("paths")), "quality-hosts")
    g = host.agg(F.sum("nh"), F.sum("sh"), F.count(F.lit(1)), F.sum(F.col("nh") * F.col("nh").cast("double"))).first()
    total, good, hosts, square = float(g[0] or 0), float(g[1] or 0), float(g[2] or 0), float(g[3] or 0)
    mu = min(max((good + 1) / (total + 2), 1e-4), 1 - 1e-4)
    spread = host.agg(F.sum(F.col("nh") * F.pow(F.col("sh") / F.col("nh") - mu, 2))).first()[0] or 0.0
    m_host = _strength(spread, (hosts - 1) * mu * (1 - mu), total - square / max(total, 1.0), mu * (1 - mu))
    ph = F.col("sh") / F.col("nh")
    both = path.join(host, path["host"].eqNullSafe(host["host"])).select(path["host"].alias("host"), "path", "np", "sp", "nh", "sh")
    own = both.agg(F.sum(F.col("np") * F.pow(F.col("sp") / F.col("np") - ph, 2))).first()[0] or 0.0
    inside = host.agg(F.sum((F.col("paths") - 1) * ph * (1 - ph)), F.sum(F.col("nh") - F.col("np2") / F.col("nh")),
                      F.sum(F.col("nh") * ph * (1 - ph))).first()
    m_path = _strength(own, inside[0] or 0.0, inside[1] or 0.0, (inside[2] or 0.0) / max(total, 1.0))
    sites = both.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "np", "sp", "nh", "sh")
    out = rows.join(sites, rows["host"].eqNullSafe(F.col("_h")) & rows["path"].eqNullSafe(F.col("_p")))
    # posteriors without the document itself
    host_prior = (F.col("sh") - F.col("v") + m_host * mu) / (F.col("nh") - 1 + m_host)
    path_prior = (F.col("sp") - F.col("v") + m_path * host_prior) / (F.col("np") - 1 + m_path)
    safe = F.least(F.greatest(path_prior, F.lit(1e-4)), F.lit(1 - 1e-4))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(safe / (1 - safe)) + F.col("log_factor"))))
    return out.select("id", "host", "path", host_prior.alias("host_prior"), path_prior.alias("path_prior"),
                      F.col("log_factor").alias("evidence"), score.alias("quality"), (score >= KEEP_FROM).alias("kept"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, train: Column, host: Column, path: Column,
                   id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, host, path, host_prior, path_prior, evidence, quality, kept."""
    features = stored(document_features(docs, id_col=id_col, text_col=text_col, host=host, path=path), "quality-features")
    model = fit_evidence(features, labels, train=train, id_col=id_col, label_col=label_col)
    factor = model.log_factor(F.col("x"))
    prior = float(np.log(model.base / (1 - model.base)))
    rows = features.select("id", "host", "path", factor.alias("log_factor"),
                           (F.lit(1.0) / (F.lit(1.0) + F.exp(-(factor + F.lit(prior))))).alias("v"))
    return hierarchical_scores(rows)
