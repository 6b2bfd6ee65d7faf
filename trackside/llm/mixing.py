"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (its share of the target volume over its
own volume). A document's copies are one draw of a Poisson variable with that
mean, found by inverting the distribution at a number hashed from seed and
document id; so the draw survives retries and does not depend on partitioning.
Rates above ``RATE_STEP`` are drawn as the sum of several smaller Poisson draws
(which is exactly Poisson), so no rate is too large for the inversion.

Defined results
* Volume of a document: its characters (null text: 0). A null source is a source
  of its own. Sources without any character keep rate 1.
* Default target weights are volume ** alpha, normalised; given weights are
  normalised over the sources present, sources without a weight get rate 0.
* Rows repeated with the same id draw the same count. Rows without an id are drawn and
  dealt by a hash of their text. Empty tables give empty results.
* Columns added: rate, n_copies, copy_no (1..n), shuffle_key; a clashing input
  column is replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import stored

RATE_STEP = 16.0
# P(Poisson(16) > 95) is below 1e-40, less than the step of the hashed number:
# the inversion never needs a later entry.
CDF_TERMS = 96
HEX_DIGITS = 13  # 52 bits, exact in a double


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its id, or where it has none the MD5 of its text, so that such rows draw one by one."""
    own = F.concat(F.lit("text:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.coalesce(doc_id.cast("string"), own)


def hashed_uniform(seed: int, part: Column, key: Column) -> Column:
    """A number in [0, 1) from md5(seed:part:key)."""
    text = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(float(2 ** 52))


def source_rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text",
                 weights: dict[str, float] | None = None, alpha: float = 0.5, volume: float = 1.0) -> DataFrame:
    """(source, chars, rate): one row per source; ``volume`` is the target over the input volume."""
    size = (docs.groupBy(F.col(source_col).alias("source"))
            .agg(F.sum(F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0))).cast("long").alias("chars")))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(alpha))
    else:
        weight = F.coalesce(F.element_at(F.create_map(
            *[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]), F.col("source")), F.lit(0.0))
    sized = size.withColumn("w", weight)
    total = sized.agg(F.sum("w").alias("tw"), F.sum("chars").cast("double").alias("tc"))
    # one row joined to one row per source
    return sized.join(F.broadcast(total)).select(
        "source", "chars",
        F.when(F.col("chars") == 0, F.lit(1.0)).when(F.col("tw") == 0, F.lit(0.0))
        .otherwise(F.col("w") / F.col("tw") * F.col("tc") * F.lit(volume) / F.col("chars")).alias("rate"))


def _cdf(rate: Column) -> Column:
    """The first ``CDF_TERMS`` values of the Poisson distribution function."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"),
                     F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(CDF_TERMS - 1)), start, step, lambda a: a["all"])


def poisson_copies(docs: DataFrame, rates: DataFrame, *, id_col: str = "doc_id", source_col: str = "source",
                   text_col: str = "text", seed: int = 42) -> DataFrame:
    """``docs`` with rate and n_copies. ``rates`` (one row per source) is joined by
    source; Spark broadcasts it where it measures it as small and splits a hot
    source's rows where it does not."""
    # written, so that its measured size decides about a broadcast before any document is shuffled
    step = stored(rates.withColumn("__draws", F.ceil(F.col("rate") / RATE_STEP).cast("int")).withColumn(
        "__cdf", _cdf(F.col("rate") / F.greatest(F.col("__draws"), F.lit(1)))).select(
        F.col("source").alias("__source"), F.col("rate").alias("__rate"), "__draws", "__cdf"), "mix-rates")
    base = docs.select(*[c for c in docs.columns if c not in ("rate", "n_copies")])
    joined = base.join(step, F.col(source_col).eqNullSafe(F.col("__source")))
    draws = F.transform(F.sequence(F.lit(1), F.greatest(F.col("__draws"), F.lit(1))),
                        lambda j: hashed_uniform(seed, j, draw_key(F.col(id_col), F.col(text_col))))
    # each draw counts the terms at or below its number: the smallest k whose value exceeds it
    n = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))
    n = F.when(F.col("__draws") == 0, F.lit(0)).otherwise(n)
    return joined.withColumn("rate", F.col("__rate")).withColumn("n_copies", n.cast("long")).drop(
        "__source", "__rate", "__draws", "__cdf")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: dict[str, float] | None = None, alpha: float = 0.5, volume: float = 1.0,
                seed: int = 42) -> DataFrame:
    """Replicated rows in a global random order: dealt to partitions by a hashed
    key per copy and sorted by it inside each partition."""
    rates = source_rates(docs, source_col=source_col, text_col=text_col, weights=weights, alpha=alpha, volume=volume)
    drawn = poisson_copies(docs, rates, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed)
    copies = drawn.filter("n_copies > 0").select(
        *[c for c in drawn.columns if c not in ("copy_no", "shuffle_key")],
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), draw_key(F.col(id_col), F.col(text_col)),
                            F.col("copy_no").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
