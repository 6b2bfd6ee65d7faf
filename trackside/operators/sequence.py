"""Per-lap ordered scans (lag, running sums, lap totals) over fixed slices of a lap.

A slice follows from the row alone: its time slice (``SLICE_SECONDS`` of lap time), and,
for samples on a slice's lower edge (time 0 above all) or without a time, the
block of ``TIE_SPAN`` tie values it falls into. Slices are intervals of the lap's
order, so a two-level scan is exact: every window runs inside one slice, and a carry
table with one row per slice holds what the slices before it hand over (the last
row's values, the running sums, the lap's totals).

A real lap is one slice, and such laps need no carry. Laps that reach further are found
by a filter on the time column, which skips Parquet row groups, so on a sound store the
table is empty and the scan is one window and one exchange. ``lap_scan`` runs this
search when it is called (it is small, but eager); everything else is lazy. Where
laps do reach further, the carry table is written to the shared folder and
joined to their rows; the windows stay the same.

Not split: samples of a lap that share one time inside a slice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside.session import stored

SLICE_SECONDS = 600.0
TIE_SPAN = 1 << 16
NULL_SPREAD = 4096
SLICE = ["_late", "_no", "_inside", "_block"]

Increment = Callable[[dict[str, Column]], Column]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def slice_columns(df: DataFrame, time_col: str, tie_col: str | None, slice_seconds: float, tie_span: int) -> dict[str, Column]:
    """The slice of a row; compared in this order, slices are in lap order (NaN, then null times last)."""
    t = F.col(time_col).cast("double")
    late = F.when(t.isNull(), 2).when(F.isnan(t), 1).otherwise(0)
    no = F.when(late == 0, F.floor(t / F.lit(float(slice_seconds)))).otherwise(F.lit(0)).cast("long")
    inside = (late == 0) & (t != no * F.lit(float(slice_seconds)))
    block = F.lit(0).cast("long")
    if tie_col and isinstance(df.schema[tie_col].dataType, T.IntegralType):
        block = F.when(~inside, F.floor(F.col(tie_col) / F.lit(tie_span))).cast("long")
        block = F.coalesce(block, F.lit(0).cast("long"))
    return dict(zip(SLICE, (late, no, inside, block)))


def _far_laps(df: DataFrame, keys: list[str], time_col: str, cut: dict[str, Column]) -> DataFrame:
    """Keys of the laps that have more than their first slice: rows outside it, or several tie blocks at time 0."""
    t = F.col(time_col)
    far = (cut["_late"] > 0) | (cut["_no"] != 0)
    rows = df.filter(_all([F.col(k).isNotNull() for k in keys])).filter(far | (t == 0))
    found = rows.groupBy(*keys).agg(F.max(far).alias("_far"), F.min(cut["_block"]).alias("_lo"), F.max(cut["_block"]).alias("_hi"))
    return stored(found.filter(F.col("_far") | (F.col("_lo") != F.col("_hi"))).select(*keys), "far-laps")


def _carry(df: DataFrame, far: DataFrame, keys: list[str], time_col: str, tie: str | None, cut: dict[str, Column],
           lags: list[str], running: dict[str, Increment], lap_last: list[str]) -> DataFrame:
    """One row per slice of the laps of ``far``: ``_has_*`` (the last row before the slice), ``_off_*``
    (running sums before it), ``_sum_*``, ``_lst_*`` and ``_cnt`` (of the whole lap)."""
    rows = df.join(far, keys, "left_semi").withColumns(cut)
    order = _order_struct(rows, time_col, tie)
    slices = Window.partitionBy(*keys).orderBy(*SLICE)
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # partial aggregates: no task holds a slice, let alone a lap
    ends = rows.groupBy(*keys, *SLICE).agg(
        F.max_by(F.struct(F.lit(1).alias("_one"), *[F.col(c) for c in dict.fromkeys([*lags, *lap_last])]), order).alias("_end"),
        F.count(F.lit(1)).alias("_n"))
    out = ends.select(*keys, *SLICE, F.lag("_end").over(slices).alias("_before"), F.last("_end").over(whole).alias("_lap_end"),
                      F.sum("_n").over(whole).alias("_cnt"))
    out = out.select(*keys, *SLICE, *[F.col(f"_before.{c}").alias(f"_has_{c}") for c in lags],
                     *[F.col(f"_lap_end.{c}").alias(f"_lst_{c}") for c in lap_last], "_cnt")
    if running:
        out = stored(out, "lap-ends")
        known = out.select(*keys, *SLICE, *[f"_has_{c}" for c in lags])
        scanned = _scan(rows.join(known, [*keys, *SLICE]), [*keys, *SLICE], time_col, tie, lags, running)
        sums = scanned.groupBy(*keys, *SLICE).agg(*[F.max_by(n, order).alias(f"_own_{n}") for n in running])
        before = slices.rowsBetween(Window.unboundedPreceding, -1)
        for n in running:
            sums = sums.withColumn(f"_off_{n}", F.sum(f"_own_{n}").over(before))
        for n in running:
            last = F.coalesce(F.col(f"_off_{n}") + F.col(f"_own_{n}"), F.col(f"_own_{n}"))
            sums = sums.withColumn(f"_sum_{n}", F.last(last).over(whole))
        out = out.join(sums.drop(*[f"_own_{n}" for n in running]), [*keys, *SLICE])
    return stored(out, "lap-carry")


def _scan(x: DataFrame, part: list[str], time_col: str, tie: str | None, lags: list[str],
          running: dict[str, Increment]) -> DataFrame:
    """Lags (the first row of a slice takes ``_has_*``) and running sums inside ``part``."""
    w = Window.partitionBy(*part).orderBy(*_order(time_col, tie))
    carried = {c for c in lags if f"_has_{c}" in x.columns}
    first = F.row_number().over(w) == 1
    x = x.select("*", *[(F.when(first, F.col(f"_has_{c}")).otherwise(F.lag(c).over(w)) if c in carried
                         else F.lag(c).over(w)).alias(f"_prev_{c}") for c in lags])
    prev = {c: F.col(f"_prev_{c}") for c in lags}
    for name, inc in running.items():
        x = x.withColumn(name, F.sum(inc(prev)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x


def lap_scan(df: DataFrame, *, keys: list[str], time_col: str, tie_col: str | None,
             lags: list[str], running: dict[str, Increment] | None = None,
             lap_totals: bool = False, lap_last: list[str] | None = None, lap_count: str | None = None,
             spread_nulls: bool = False, along: list[str] | None = None, slice_seconds: float | None = None,
             tie_span: int | None = None) -> DataFrame:
    """Add ``_prev_<c>`` for every ``lags`` column (previous row in lap order, null
    at the lap start), one running inclusive sum per ``running`` entry (the
    callable builds the per-row increment from the ``_prev_*`` columns), and
    optionally ``<name>_lap_total`` (the last running value of the lap),
    ``_last_<c>`` (value at the lap's last row) and ``lap_count`` (rows in the lap).

    Lap order = ``time_col`` ascending, NaN and nulls last, then ``tie_col``. ``along`` names
    columns that are fixed per lap; with them the scan can use an exchange that is already there.
    Rows with a null key form one lap, or with ``spread_nulls`` are dealt to
    ``NULL_SPREAD`` partitions (their values then mean nothing).
    """
    running, lap_last = running or {}, lap_last or []
    tie = tie_col if tie_col and tie_col in df.columns else None
    cut = slice_columns(df, time_col, tie, SLICE_SECONDS if slice_seconds is None else slice_seconds,
                        TIE_SPAN if tie_span is None else tie_span)
    cols, x, part = df.columns, df, [*keys, *(along or [])]
    far = _far_laps(df, keys, time_col, cut)
    sliced = not far.isEmpty()
    if sliced:
        carry = _carry(df, far, keys, time_col, tie, cut, lags, running, lap_last).withColumn("_far", F.lit(True))
        x = x.withColumns(cut).join(carry, [*keys, *SLICE], "left")
        # laps of one slice stay in one partition, whatever slice columns their rows have
        x = x.withColumns({c: F.when(F.col("_far"), F.col(c)) for c in SLICE})
        part = [*part, *SLICE]
    if spread_nulls:
        keys_ok = _all([F.col(k).isNotNull() for k in keys])
        x = x.withColumn("_spread", F.when(keys_ok, F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(NULL_SPREAD))))
        part = [*part, "_spread"]
    x = _scan(x, part, time_col, tie, lags, running)
    lap = Window.partitionBy(*part)
    order = _order_struct(x, time_col, tie)

    def of_lap(column: str, value: Column) -> Column:
        return F.coalesce(F.when(F.col("_far"), F.col(column)), value) if sliced else value

    added = {}
    for n in running:
        if lap_totals:
            added[f"{n}_lap_total"] = of_lap(f"_sum_{n}", F.max_by(n, order).over(lap))
        if sliced:
            added[n] = F.coalesce(F.col(f"_off_{n}") + F.col(n), F.col(n))
    for c in lap_last:
        own = F.max_by(c, order).over(lap)
        added[f"_last_{c}"] = F.when(F.col("_far"), F.col(f"_lst_{c}")).otherwise(own) if sliced else own
    if lap_count:
        added[lap_count] = of_lap("_cnt", F.count(F.lit(1)).over(lap))
    x = x.withColumns(added) if added else x
    keep = [*cols, *[f"_prev_{c}" for c in lags], *running, *[c for c in added if c not in running]]
    return x.select(*keep)


def _order(time_col: str, tie: str | None) -> list[Column]:
    return [F.col(time_col).asc_nulls_last(), *([F.col(tie).asc()] if tie else [])]


def _order_struct(df: DataFrame, time_col: str, tie_col: str | None) -> Column:
    parts = [F.col(time_col).isNull(), F.col(time_col)]
    if tie_col and tie_col in df.columns:
        parts.append(F.col(tie_col))
    return F.struct(*parts)
