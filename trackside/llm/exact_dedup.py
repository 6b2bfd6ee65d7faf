"""Exact de-duplication by progressive refinement (DataFrame functions only).

Length groups first, then a hash of the first characters, then the hash of the
whole text; each level looks only at rows whose group still has two members.

Defined results
* A null text counts as empty; texts are equal when identical after lower-casing
  A-Z. Empty texts are equal to each other.
* Of equal texts the row with the largest id stays. A null id loses against any id.
  Rows repeated with the same id and text: exactly one of them is ``kept``.
* An empty table gives an empty result. Extra columns are ignored by
  ``exact_groups`` and carried unchanged by ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import ascii_lower, first_row, stored

PREFIX_CHARS = 64


def _normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def _levels(docs: DataFrame, id_col: str, text_col: str, extra: list[Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).alias("len"),
        F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"),
        *extra)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 digest_all: bool = False) -> DataFrame:
    """One row per input row: id, len, prefix, sha, key (a 64-bit hash of the whole normalised text), keep_id,
    group_size, kept.

    ``sha`` is the hash of the whole normalised text, taken only for rows whose
    (length, prefix) group has at least two members; with ``digest_all`` it is
    reported for every row.
    """
    first = stored(_levels(docs, id_col, text_col, []), "exact-levels")
    # the small results are written, so that the joins below deal out a hot key's rows anew
    by_len = stored(first.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len"), "exact-lengths")
    by_prefix = stored(first.join(by_len, "len", "left_semi").groupBy("len", "prefix")
                       .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                       .select("len", "prefix", F.lit(True).alias("open")), "exact-prefixes")
    norm = _normalised(F.col(text_col))
    if digest_all:
        rows = (_levels(docs, id_col, text_col, [F.sha2(norm, 256).alias("sha"), F.lit(None).cast("long").alias("key")])
                .join(by_prefix, ["len", "prefix"], "left"))
    else:
        # the whole text is hashed behind the join, for open groups only
        rows = (_levels(docs, id_col, text_col, [F.col(text_col).alias("whole")])
                .join(by_prefix, ["len", "prefix"], "inner")
                .withColumn("sha", F.sha2(_normalised(F.col("whole")), 256))
                .withColumn("key", F.xxhash64(_normalised(F.col("whole")))).drop("whole"))
    rows = stored(rows.select("id", "len", "prefix", "sha", "key", F.coalesce("open", F.lit(False)).alias("open"),
                              F.monotonically_increasing_id().alias("row")), "exact-rows")
    groups = stored(rows.filter("open").groupBy("len", "prefix", "sha")
                    .agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1"), "exact-groups")
    out = rows.join(groups, ["len", "prefix", "sha"], "left")
    alone = F.col("keep").isNull()
    return out.select(
        "id", "len", "prefix", "sha", "key",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that lose against an equal text; columns unchanged.

    Losing rows are removed by an anti join on id and a 64-bit hash of the text; two texts of
    one id would have to share that hash to be confused. Rows that repeat the id of the kept
    row with an equal text are reduced to the one whose other columns sort first.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col).filter("group_size > 1")
    fate = groups.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    tag = "__x"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    # written and narrow, so that texts are shuffled only where the losers are too many to broadcast
    gone = stored(fate.filter(~F.col("kept") | (F.col("copies") > 1)).select(
        F.col("id").alias(tag + "id"), F.col("key").alias(tag + "key"), F.col("kept").alias(tag + "kept")), "exact-losers")
    met = (F.col(id_col).eqNullSafe(F.col(tag + "id"))
           & (F.xxhash64(_normalised(F.col(text_col))) == F.col(tag + "key")))
    out = docs.join(gone.drop(tag + "kept"), met, "left_anti")
    repeated = gone.filter(F.col(tag + "kept"))
    if repeated.isEmpty():
        return out
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    one = (docs.join(repeated, met).groupBy(F.col(tag + "id"), F.col(tag + "key"))
           .agg(F.min(F.col(id_col)).alias(tag + "i"), first_row([*rest, text_col]).alias(tag + "row"))
           .select(*[F.col(tag + "i").alias(c) if c == id_col else F.col(tag + "row").getField(c).alias(c)
                     for c in docs.columns]))
    return out.unionByName(one)
