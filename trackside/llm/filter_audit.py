"""What every order of a set of filters keeps, removes and loses, from tables of failing ids.

One table per filter holds the rows that fail it. A left-anti join with it finds
the survivors of every prefix that the filter joins, a left-semi join the rows it
stops. The prefixes are carried together: ``alive`` has one bit per set of filters,
set while the row survives that set, so a filter costs two joins whatever the
number of orders. Rows that fail nothing never enter a join; they are counted from
the totals. What the orders differ in is then read from one small row per part.

Defined results
* A null text counts as empty. Words are runs of anything but space and \\x09-\\x0D.
* ``Duplicate``: a row fails if an equal text stands under a smaller id, anywhere in the
  table. A row without an id neither fails it nor makes others fail; rows that repeat
  an id with the same text do not fail because of each other.
* Rows are judged one by one: repeated rows count as often as they occur. A null part
  is the empty string. Labels belong to ids: a row is good (toxic) if any label row
  of its id says so; null ids and ids without labels are neither.
* An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import fresh_path, stored

SEPARATORS = " \t\n\x0b\x0c\r"
MAX_FILTERS = 6  # one bit of a long per set of filters


@dataclass(frozen=True)
class Measures:
    """What a rule may look at."""

    text: Column
    n_words: Column
    n_distinct: Column


class Duplicate:
    """The rule that a row fails if its text is that of a smaller id."""


Rule = Callable[[Measures], Column]


def judge(docs: DataFrame, rules: Mapping[str, Rule | Duplicate], *, part: Column, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """row (a number for each row), id, part, digest of the text, failed (names of the rules it fails by itself)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.split(F.btrim("text", F.lit(SEPARATORS)), "[\\x20\\x09-\\x0D]+"))
    rows = rows.select("id", "part", "text", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long").alias("n"),
                       F.when(F.element_at("words", 1) == "", 0).otherwise(F.size(F.array_distinct("words"))).cast("long").alias("d"))
    seen = Measures(F.col("text"), F.col("n"), F.col("d"))
    failed = F.array_compact(F.array(*[F.when(rule(seen), F.lit(name)) for name, rule in rules.items()
                                       if not isinstance(rule, Duplicate)])).cast("array<string>")
    # the row numbers are written, so that they stay the same in every later read
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "part",
                              F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed")), "audit-rows")


def failing_ids(judged: DataFrame, rules: Mapping[str, Rule | Duplicate]) -> dict[str, DataFrame]:
    """One stored table (row, id, part) per rule."""
    fails = judged.select("row", "id", "part", F.explode("failed").alias("filter"))
    for name, rule in rules.items():
        if isinstance(rule, Duplicate):
            shared = stored(judged.filter(F.col("id").isNotNull()).groupBy("digest")
                            .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                            .select("digest", "first_id"), "audit-shared", "none")
            fails = fails.unionByName(judged.join(shared, "digest").filter("id > first_id")
                                      .select("row", "id", "part", F.lit(name).alias("filter")))
    path = fresh_path(judged.sparkSession, "audit-fails")
    # plain files, so that Spark decides on a broadcast by about the size the rows have in memory
    fails.write.partitionBy("filter").option("compression", "none").parquet(path)
    read = judged.sparkSession.read.schema(fails.schema).parquet(path)
    return {name: read.filter(F.col("filter") == name).drop("filter") for name in rules}


def prefix_survivors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """row, id, part, alive: bit S of ``alive`` is set if the row survives the filters of the set S.

    Bit i of S stands for the i-th table. Only rows that fail something appear."""
    rows = None
    for table in tables.values():
        rows = table if rows is None else rows.unionByName(table)
    rows = rows.distinct().withColumn("alive", F.lit(1).cast("long"))
    for i, (name, table) in enumerate(tables.items()):
        stopped = table.select("row")
        rows = stored(rows, f"audit-before-{name}")
        grown = F.col("alive").bitwiseOR(F.shiftleft("alive", 1 << i))
        rows = (rows.join(stopped, "row", "left_anti").withColumn("alive", grown)
                .unionByName(rows.join(stopped, "row", "left_semi")))
    return stored(rows, "audit-alive")


def removals(survivors: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """filter, id, part, alive: the rows each filter stops, with the prefixes that leave them to it."""
    out = None
    for name, table in tables.items():
        one = survivors.join(table.select("row"), "row", "left_semi").select(F.lit(name).alias("filter"), "id", "part", "alive")
        out = one if out is None else out.unionByName(one)
    return stored(out, "audit-removals")


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Rule | Duplicate], *, part: Column, id_col: str = "doc_id",
          text_col: str = "text", label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders)."""
    names = list(rules)
    if not 1 <= len(names) <= MAX_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MAX_FILTERS} filters, each named by one letter")
    every = (1 << len(names)) - 1
    judged = judge(docs, rules, part=part, id_col=id_col, text_col=text_col)
    tables = failing_ids(judged, rules)
    alive = prefix_survivors(tables)
    cut = removals(alive, tables)

    labelled = lambda c: stored(labels.filter(F.col(c) == 1).select(F.col(label_id).alias("id"))
                                .distinct(), f"audit-{c}", "none")
    counted = lambda df, as_: df.groupBy("part", "filter", "alive").agg(F.count(F.lit(1)).alias(as_))
    kinds = {"n": cut, "good": cut.join(labelled(good), "id", "left_semi"), "toxic": cut.join(labelled(toxic), "id", "left_semi")}
    counts = None
    for kind, df in kinds.items():
        one = counted(df, kind)
        counts = one if counts is None else counts.unionByName(one, allowMissingColumns=True)
    has = lambda s: F.shiftright("alive", s).bitwiseAND(F.lit(1).cast("long"))

    # a few hundred rows a part from here on
    sets = lambda keep: F.explode(F.array(*[F.lit(s) for s in range(every + 1) if keep(s)])).alias("set")
    per_set = None
    for i, name in enumerate(names):
        one = counts.filter(F.col("filter") == name).select("*", sets(lambda s, i=i: not s >> i & 1))
        per_set = one if per_set is None else per_set.unionByName(one)
    alive_in_set = F.expr("shiftright(alive, set) & 1")
    total = lambda c: F.coalesce(F.sum(F.col(c) * alive_in_set), F.lit(0))
    per_set = per_set.groupBy("part", "filter", "set").agg(
        total("n").alias("removed"), F.coalesce(F.sum("n"), F.lit(0)).alias("failing"),
        total("good").alias("good_lost"), total("toxic").alias("toxic_lost"))
    orders_of = [math.factorial(k) * math.factorial(len(names) - 1 - k) for k in range(len(names))]  # by size of the prefix
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in orders_of]), F.bit_count("set") + F.lit(1))
    others = F.lit(every) - F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))]),
                                         F.col("filter"))
    by_filter = (per_set.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(F.col("set") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.map_from_entries(F.collect_list(F.struct("set", F.struct(
            "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "good_lost", "toxic_lost")))).alias("sets"))
        .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(
            "filter", F.struct("shapley", "unique_fails", "sets")))).alias("filters")))
    lost = (alive.groupBy("part", "alive").agg(F.count(F.lit(1)).alias("n")).groupBy("part")
            .agg(F.array(*[F.sum(F.col("n") * (F.lit(1) - has(s))) for s in range(every + 1)]).alias("lost")))
    parts = (judged.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"))
             .join(lost, "part", "left").join(by_filter, "part", "left"))

    bit = {n: 1 << i for i, n in enumerate(names)}
    steps = F.array(*[F.struct(F.lit("".join(order)).alias("order"), F.lit(k + 1).alias("step"), F.lit(order[k]).alias("filter"),
                               F.lit(sum(bit[n] for n in order[:k])).alias("before"),
                               F.lit(sum(bit[n] for n in order[:k + 1])).alias("after"))
                      for order in itertools.permutations(names) for k in range(len(names))])
    rows = parts.select("*", F.explode(steps).alias("s"))
    mine = F.try_element_at("filters", F.col("s.filter"))
    here = F.try_element_at(mine["sets"], F.col("s.before"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "part", F.col("s.order").alias("filter_order"), F.col("s.step").alias("step"),
        (F.col("n_docs") - zero(F.try_element_at("lost", F.col("s.after") + F.lit(1)))).alias("kept"),
        zero(here["removed"]).alias("removed"), zero(here["redundant"]).alias("redundant"),
        zero(mine["unique_fails"]).alias("unique_fails"), zero(here["good_lost"]).alias("good_lost"),
        zero(here["toxic_lost"]).alias("toxic_lost"), zero(mine["shapley"]).alias("shapley"))
