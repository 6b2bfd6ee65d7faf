"""A dyadic interval index: which integer intervals hold a point, as an equi-join.

An interval is covered by its canonical nodes: blocks of 2^k integers, aligned to 2^k,
at most two a level and so at most 2 log2(length) in all (beyond 2^LEVELS, one more for each
such block). A point
lies in one block of each level; an interval holds the point if and only if one of
its nodes is among them, and then exactly one. So intervals and points meet in
a join on (keys, level, node), without pairs that do not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 20  # blocks of up to 2^20 integers; longer intervals take one node per 2^20 on top


def cover(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """Array of (level, node) whose blocks make up [low, high]; empty if low > high or either is null.

    At level k the aligned blocks inside the interval are ceil(low / 2^k) to
    floor((high + 1) / 2^k) - 1; the first or last belongs to the cover if its pair lies outside."""
    first_after = (high + F.lit(1)).cast("long")

    def at(k: Column) -> Column:
        left = -F.call_function("shiftright", -low.cast("long"), k)
        right = F.call_function("shiftright", first_after, k)
        inside = left < right
        top = k == levels
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        odd = lambda n: n.bitwiseAND(F.lit(1).cast("long")) == 1
        ends = F.array(F.when(inside & odd(left), node(left)), F.when(inside & odd(right), node(right - 1)))
        # no level above: every block that is left
        rest = F.when(inside & top, F.transform(F.sequence(left, F.greatest(right - 1, left)), node))
        return F.when(top, F.coalesce(rest, F.filter(ends, lambda x: F.lit(False)))).otherwise(ends)

    nodes = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda x: x.isNotNull())
    return F.when(low <= high, nodes)


def blocks_of(point: Column, levels: int = LEVELS) -> Column:
    """Array of the (level, node) that hold ``point``, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(
        k.alias("level"), F.call_function("shiftright", point.cast("long"), k).alias("node")))


def stab(points: DataFrame, intervals: DataFrame, *, by: list[str], point: str, low: str, high: str,
         levels: int = LEVELS) -> DataFrame:
    """Every (point, interval) pair of equal ``by`` with low <= point <= high: the columns of ``points``
    and of ``intervals`` without low, high and the second ``by``. Null keys and bounds match nothing."""
    index = intervals.withColumn("_n", F.explode(cover(F.col(low), F.col(high), levels))).drop(low, high)
    probe = points.withColumn("_n", F.explode(blocks_of(F.col(point), levels)))
    flat = lambda df: df.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    return flat(probe).join(flat(index), [*by, "_level", "_node"]).drop("_level", "_node")
