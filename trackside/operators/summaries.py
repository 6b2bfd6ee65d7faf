"""Per-driver / per-corner summaries, counts, histograms and top-k (AG-4..8, AG-17..21, TK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.exprs import brake_numeric
from trackside.operators.common import drop_null_keys, mean, sample_sort_cols, rank_in_group, top_n


def _brake_num(df: DataFrame) -> Column:
    return brake_numeric("Brake", df.schema["Brake"].dataType)


def driver_summary(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS, digits: int | None = 1,
                   exact_mean: bool = False) -> DataFrame:
    """AG-4: Avg/Max Speed, Avg Throttle, Brake_Pct, Avg/Max RPM, distinct laps,
    rows, rounded half-even to ``digits``.

    Two-level aggregate: partial sums per lap (on the per-lap partitioning, no
    exchange), then per driver; the distinct lap count is the number of non-null
    lap groups, so no row-duplicating distinct expansion is planned."""
    work = drop_null_keys(df, [S.DRIVER_COL]).withColumn("_b", _brake_num(df))

    def tot(c):
        col = F.col(c)
        return F.sum(col.cast("decimal(38,18)") if exact_mean else col.cast("double"))

    per_lap = work.groupBy(*keys, S.DRIVER_COL, S.LAP_COL).agg(
        *[e for c in ("Speed", "Throttle", "_b", "RPM") for e in (tot(c).alias(f"_s_{c}"),
                                                                  F.count(c).alias(f"_n_{c}"))],
        F.max("Speed").alias("_max_Speed"), F.max("RPM").alias("_max_RPM"), F.count(F.lit(1)).alias("_rows"))

    def avg(c):
        s_, n_ = F.sum(f"_s_{c}"), F.sum(f"_n_{c}")
        return F.when(n_ > 0, s_.cast("double") / n_.cast("double"))

    agg = per_lap.groupBy(*keys, S.DRIVER_COL).agg(
        avg("Speed").alias("Avg_Speed"), F.max("_max_Speed").alias("Max_Speed"),
        avg("Throttle").alias("Avg_Throttle"), (avg("_b") * 100.0).alias("Brake_Pct"),
        avg("RPM").alias("Avg_RPM"), F.max("_max_RPM").alias("Max_RPM"),
        F.count(S.LAP_COL).alias("Laps"), F.sum("_rows").alias("Data_Points"),
    )
    if digits is not None:
        for c in ("Avg_Speed", "Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM", "Max_RPM"):
            agg = agg.withColumn(c, F.bround(c, digits))
    return agg


def corner_summary(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """AG-5: per (driver, corner): Min_Speed over all rows, Max_Deceleration = min
    Acceleration over Deceleration rows, Max_Acceleration_Exit = max over
    Acceleration rows, Data_Points."""
    work = df.filter(F.col("Corner").isNotNull() & F.col(S.DRIVER_COL).isNotNull())
    return work.groupBy(*keys, S.DRIVER_COL, "Corner").agg(
        F.min("Speed").alias("Min_Speed"),
        F.min(F.when(F.col("Accel_Type") == "Deceleration", F.col("Acceleration"))).alias("Max_Deceleration"),
        F.max(F.when(F.col("Accel_Type") == "Acceleration", F.col("Acceleration"))).alias("Max_Acceleration_Exit"),
        F.count(F.lit(1)).alias("Data_Points"),
    )


def corner_events(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """AG-6: per (driver, corner) min Speed, min and max Acceleration (no class filter)."""
    work = df.filter(F.col("Corner").isNotNull() & F.col(S.DRIVER_COL).isNotNull())
    return work.groupBy(*keys, S.DRIVER_COL, "Corner").agg(
        F.min("Speed").alias("Min_Speed"),
        F.min("Acceleration").alias("Max_Deceleration"),
        F.max("Acceleration").alias("Max_Acceleration_Exit"),
    )


STAT_FUNCS = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def multi_stats(df: DataFrame, spec: dict[str, list[str]], *, keys: list[str] = S.SESSION_KEYS,
                by: list[str] = (S.DRIVER_COL,), digits: int | None = 2,
                exact_mean: bool = False) -> DataFrame:
    """AG-7: ``groupBy.agg`` from a {column: [stat, ...]} spec, flat names ``col_stat``.
    Boolean columns are averaged as 0/1."""
    work = drop_null_keys(df, list(by))
    exprs = []
    for col, stats in spec.items():
        c = F.col(col)
        if dict(work.dtypes).get(col) == "boolean":
            c = c.cast("int")
        for st in stats:
            e = mean(c, True) if (st == "mean" and exact_mean) else STAT_FUNCS[st](c)
            e = e.cast("double")
            if digits is not None:
                e = F.bround(e, digits)
            exprs.append(e.alias(f"{col}_{st}"))
    return work.groupBy(*keys, *by).agg(*exprs)


QUALI_STATS = {"Throttle": ["mean", "max", "min"], "Brake": ["mean", "max"],
               "Speed": ["mean", "max"], "RPM": ["mean", "max"]}
RACE_STATS = {"Throttle": ["mean", "max"], "Brake": ["mean", "max"], "Speed": ["mean", "max"],
              "RPM": ["mean", "max"], "LapNumber": ["max"]}


def driver_corner_deep_dive(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                            exact_mean: bool = False) -> DataFrame:
    """AG-8 (per corner): data points, min/max speed, min/max acceleration, mean
    throttle and mean brake (0/1) for every driver and corner at once."""
    work = df.filter(F.col("Corner").isNotNull() & F.col(S.DRIVER_COL).isNotNull())
    return work.groupBy(*keys, S.DRIVER_COL, "Corner").agg(
        F.count(F.lit(1)).alias("Data_Points"),
        F.min("Speed").alias("Min_Speed"), F.max("Speed").alias("Max_Speed"),
        F.min("Acceleration").alias("Max_Deceleration"), F.max("Acceleration").alias("Max_Acceleration"),
        mean("Throttle", exact_mean).alias("Avg_Throttle"), mean(_brake_num(work), exact_mean).alias("Avg_Brake"),
    )


def driver_session_deep_dive(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                             exact_mean: bool = False) -> DataFrame:
    """AG-8 (whole session): points, laps completed, mean/max of throttle, brake, speed."""
    work = drop_null_keys(df, [S.DRIVER_COL])
    b = _brake_num(work)
    return work.groupBy(*keys, S.DRIVER_COL).agg(
        F.count(F.lit(1)).alias("Data_Points"), F.max(S.LAP_COL).alias("Laps_Completed"),
        mean("Throttle", exact_mean).alias("Avg_Throttle"), F.max("Throttle").alias("Max_Throttle"),
        mean(b, exact_mean).alias("Avg_Brake"), F.max(b).alias("Max_Brake"),
        mean("Speed", exact_mean).alias("Avg_Speed"), F.max("Speed").alias("Max_Speed"),
    )


def kpi_counts(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS, approximate: bool = False) -> DataFrame:
    """AG-17: rows, distinct drivers, distinct corners, distinct LapNumber values
    (not driver x lap) per session; ``approximate`` uses HyperLogLog++ at scale."""
    cd = F.approx_count_distinct if approximate else F.countDistinct
    rows = F.count(F.lit(1))
    if not approximate:
        # count the few distinct (driver, corner, lap) combinations, not every sample four times
        df = df.groupBy(*keys, S.DRIVER_COL, "Corner", S.LAP_COL).agg(F.count(F.lit(1)).alias("_rows"))
        rows = F.sum("_rows")
    return df.groupBy(*keys).agg(
        rows.alias("Rows"), cd(S.DRIVER_COL).alias("Drivers"),
        cd("Corner").alias("Corners"), cd(S.LAP_COL).alias("Laps"),
    )


def distinct_sorted(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG-18: sorted distinct values (nulls dropped)."""
    return drop_null_keys(df.select(*cols), cols).distinct().orderBy(*cols)


def dedupe_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """AG-19: keep the first row per key under an explicit order.

    Written as ``min_by`` over a struct of all columns, a partial (map-side)
    aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*[F.col(c) for c in rest])
    ordk = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*key).agg(F.min_by(packed, ordk).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def histogram(df: DataFrame, col: str, bins: int = 40, *, by: list[str] = S.SESSION_KEYS) -> DataFrame:
    """AG-20: equal-width histogram per group: [min, max] split in ``bins``; the
    maximum falls in the last bin. Min/max are a partial aggregate joined back on
    the group keys (one row per group)."""
    work = df.filter(F.col(col).isNotNull())
    rng = work.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))
    return (work.join(rng, list(by), "inner").withColumn("Bin", b)
            .groupBy(*by, "Bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("Count"))
            .withColumn("Bin_Lo", F.col("_lo") + F.col("Bin") * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
            .drop("_lo", "_hi"))


def category_counts(df: DataFrame, col: str, *, by: list[str] = ()) -> DataFrame:
    """AG-20 (categorical): count per value."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("Count"))


def corner_leaders(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS, n: int = 10,
                   reference_tail: bool = False) -> DataFrame:
    """AG-21 + TK-4: per corner, top-n drivers by strongest deceleration (lowest
    min Acceleration over Deceleration rows) and by highest exit acceleration.

    ``reference_tail=True`` reproduces the analysed notebook, whose deceleration
    list keeps the n *weakest* values (sorted ascending, then the tail)."""
    cs = corner_summary(df, keys=keys)
    # Both boards in one long table and one window (one pass over the summary).
    dec_key = -F.col("Max_Deceleration") if reference_tail else F.col("Max_Deceleration")
    boards = F.explode(F.array(
        F.struct(F.lit("Deceleration").alias("Board"), F.col("Max_Deceleration").alias("Value"),
                 dec_key.alias("_k")),
        F.struct(F.lit("Acceleration").alias("Board"), F.col("Max_Acceleration_Exit").alias("Value"),
                 (-F.col("Max_Acceleration_Exit")).alias("_k"))))
    long = (cs.select(*keys, "Corner", S.DRIVER_COL, boards.alias("_e"))
            .select(*keys, "Corner", S.DRIVER_COL, "_e.*").filter(F.col("Value").isNotNull()))
    ranked = top_n(long, [*keys, "Corner", "Board"], [F.col("_k"), F.col(S.DRIVER_COL)], n,
                   salt_by=[S.DRIVER_COL])
    return ranked.select(*keys, "Corner", "Board", "Rank", S.DRIVER_COL, "Value")


def top_decel_events(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS, n: int = 15) -> DataFrame:
    """TK-3: the n strongest (most negative) corner deceleration events per session."""
    ev = corner_events(df, keys=keys).filter(F.col("Max_Deceleration").isNotNull())
    order = [F.col("Max_Deceleration").asc(), F.col(S.DRIVER_COL), F.col("Corner")]
    return top_n(ev, list(keys), order, n, salt_by=[S.DRIVER_COL, "Corner"])


def head_per_key(df: DataFrame, key: list[str], n: int, order: list[Column] | None = None) -> DataFrame:
    """TK-6: first n rows per key in sample order (two-phase top-n, so a key
    holding many samples is split before ranking)."""
    order = sample_sort_cols(df) if order is None else order
    return top_n(df, key, order, n, rank_col="RowInKey")


def corner_bars(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """CH-5 / TK-7: corner summary rounded to 2 (half-even) with bar orderings:
    ``Speed_Order`` by Min_Speed and ``Decel_Order`` by Max_Deceleration (non-null)."""
    cs = corner_summary(df, keys=keys)
    group = [*keys, "Corner"]
    out = rank_in_group(cs, group, [F.col("Min_Speed").asc_nulls_first(), F.col(S.DRIVER_COL).asc()], "Speed_Order")
    out = rank_in_group(out, group, [F.col("Max_Deceleration").asc_nulls_last(), F.col(S.DRIVER_COL).asc()], "Decel_Order")
    out = out.withColumn("Decel_Order", F.when(F.col("Max_Deceleration").isNotNull(), F.col("Decel_Order")))
    for c in ("Min_Speed", "Max_Deceleration", "Max_Acceleration_Exit"):
        out = out.withColumn(c, F.bround(c, 2))
    return out


def filter_drivers(df: DataFrame, drivers: list[str] | DataFrame, col: str = S.DRIVER_COL) -> DataFrame:
    """FLT-2: keep the given drivers. A Python list becomes an ``isin`` predicate
    (pushed to the scan); a DataFrame of drivers becomes a left semi join."""
    if isinstance(drivers, DataFrame):
        return df.join(drivers.select(F.col(drivers.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.filter(F.col(col).isin(list(drivers)))
