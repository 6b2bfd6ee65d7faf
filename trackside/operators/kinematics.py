"""Acceleration, acceleration class and corner tagging (WN-1, SC-4..7, JN-6, PL-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import schemas as S
from trackside.functions.exprs import accel_type, clip_symmetric
from trackside.operators.sequence import lap_scan


def add_acceleration(df: DataFrame, *, keys: list[str] = S.SESSION_KEYS,
                     seq_keys: tuple[str, ...] = ("DriverNumber", S.LAP_COL), along: tuple[str, ...] = (S.DRIVER_COL,),
                     clip: float = S.ACCEL_CLIP) -> DataFrame:
    """WN-1: ``Speed_ms`` and ``Acceleration`` = d(Speed/3.6)/d(TimeInLap) against the
    previous sample of the same lap, only where dt > 0, clipped to +-clip; the first
    sample of a lap, dt <= 0 and null keys give null. Adds ``Accel_Type`` (SC-4).

    One ordered scan per lap (``operators.sequence.lap_scan``: partition = session
    keys + car + lap, order = TimeInLap, sample_id, in slices of ten minutes). ``along``
    names columns that are fixed per car and session: with them the scan can use an
    exchange on (session, Driver, lap) that is already there, or serve the later ones.
    """
    keys_ok = None
    for k in seq_keys:
        e = F.col(k).isNotNull()
        keys_ok = e if keys_ok is None else keys_ok & e
    # Samples without a car or lap number get no acceleration (T3); they are
    # spread over many window partitions instead of forming one null group.
    out = df.withColumn("Speed_ms", F.col("Speed") / F.lit(S.KMH_PER_MS))
    out = lap_scan(out, keys=list(keys) + list(seq_keys), time_col=S.TIME_COL, tie_col=S.SAMPLE_ID,
                   lags=[S.TIME_COL, "Speed_ms"], spread_nulls=True,
                   along=[c for c in along if c in df.columns])
    dt = F.col(S.TIME_COL) - F.col(f"_prev_{S.TIME_COL}")
    dv = F.col("Speed_ms") - F.col("_prev_Speed_ms")
    acc = F.when(keys_ok & (dt > 0), clip_symmetric(dv / dt, clip))
    out = out.withColumn("Acceleration", acc).drop(f"_prev_{S.TIME_COL}", "_prev_Speed_ms")
    return out.withColumn("Accel_Type", accel_type("Acceleration"))


def corner_cells(corners: DataFrame, max_distance: float) -> DataFrame:
    """A spatial hash of a corner table: per round and square cell of side ``max_distance`` the
    corners whose centre lies in the cell or one of its eight neighbours, which are all that can
    be nearer than ``max_distance`` to a point of the cell. Of corners with one centre the earliest counts."""
    side = F.lit(float(max_distance))
    around = lambda c: F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]),
                                   lambda d: F.floor(c / side).cast("long") + d.cast("long"))
    centres = (corners.select(F.col("Round").cast("int").alias("_c_round"), F.col("corner_ord").alias("ord"),
                              F.col("Corner").alias("name"), ((F.col("x_lo") + F.col("x_hi")) / 2.0).alias("cx"),
                              ((F.col("y_lo") + F.col("y_hi")) / 2.0).alias("cy"))
               .groupBy("_c_round", "cx", "cy").agg(F.min(F.struct("ord", "name")).alias("_first")))
    return (centres.withColumn("_c_x", F.explode(around(F.col("cx")))).withColumn("_c_y", F.explode(around(F.col("cy"))))
            .groupBy("_c_round", "_c_x", "_c_y")
            .agg(F.collect_list(F.struct("_first.ord", "_first.name", "cx", "cy")).alias("_c_arr")))


def _corner_struct_array(corners: list[tuple]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"),
                 F.lit((float(xr[0]) + float(xr[1])) / 2.0).alias("cx"),
                 F.lit((float(yr[0]) + float(yr[1])) / 2.0).alias("cy"))
        for i, (name, xr, yr) in enumerate(corners)
    ])


def _nearest(arr: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(arr, lambda c: F.struct(
        F.sqrt((x - c["cx"]) * (x - c["cx"]) + (y - c["cy"]) * (y - c["cy"])).alias("dist"),
        c["ord"].alias("ord"), c["name"].alias("name"))))


def tag_corners(df: DataFrame, corners: dict | DataFrame | None = None, *,
                round_col: str = "Round", max_distance: float = S.CORNER_MAX_DISTANCE,
                out_col: str = "Corner") -> DataFrame:
    """JN-6: nearest corner centre per sample, kept when the distance is < max_distance.

    ``corners`` is either a dict ``round -> [(name, (x_lo, x_hi), (y_lo, y_hi)), ...]``
    (compiled into a literal map: a pure projection, no join) or a DataFrame of
    ``CORNER_SCHEMA`` rows, joined by round and grid cell (``corner_cells``), so a sample
    is compared with the corners around it only. Ties go to the earlier corner;
    null X/Y or no corners -> null.
    """
    corners = S.CIRCUIT_CORNERS if corners is None else corners
    x, y = F.col("X"), F.col("Y")
    if isinstance(corners, dict):
        if not corners:
            return df.withColumn(out_col, F.lit(None).cast("string"))
        cmap = F.create_map(*[e for rnd, cs in corners.items()
                              for e in (F.lit(int(rnd)), _corner_struct_array(cs))])
        arr = F.try_element_at(cmap, F.col(round_col).cast("int"))
        base = df
    else:
        near = corner_cells(corners, max_distance)
        cell = [F.floor(c / F.lit(float(max_distance))).cast("long") for c in (x, y)]
        base = df.join(near, (F.col(round_col).cast("int") == F.col("_c_round")) & (cell[0] == F.col("_c_x"))
                       & (cell[1] == F.col("_c_y")), "left")
        arr = F.col("_c_arr")
    best = _nearest(arr, x, y)
    tagged = F.when(x.isNotNull() & y.isNotNull() & (best["dist"] < max_distance), best["name"])
    out = base.withColumn(out_col, tagged)
    return out if isinstance(corners, dict) else out.drop("_c_round", "_c_x", "_c_y", "_c_arr")


def process_telemetry(df: DataFrame, *, corners: dict | DataFrame | None = None,
                      keys: list[str] = S.SESSION_KEYS) -> DataFrame:
    """PL-1: corner tagging + acceleration for all sessions at once."""
    return add_acceleration(tag_corners(df, corners), keys=keys)
