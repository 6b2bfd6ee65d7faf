"""Telemetry scalar expressions (SC-3..SC-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside import schemas as S


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def brake_numeric(c, dtype: T.DataType | None = None) -> Column:
    """Brake -> 0/1 (SC-3).

    Booleans cast directly (null -> 0); numeric brake columns use ``!= 0``;
    text maps ``true``/``1`` to 1 after trim+lower and everything else to 0.
    """
    col = _col(c)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(col.cast("int"), F.lit(0))
    if isinstance(dtype, T.NumericType):
        return F.when(col.isNotNull() & (col != 0), F.lit(1)).otherwise(F.lit(0))
    txt = F.lower(F.trim(col.cast("string")))
    return F.when(txt.isin("true", "1"), F.lit(1)).otherwise(F.lit(0))


def clip_symmetric(c, bound: float = S.ACCEL_CLIP) -> Column:
    """Clip to [-bound, bound]; null stays null (T2)."""
    col = _col(c)
    return F.when(col.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), col)))


def accel_type(c, threshold: float = S.ACCEL_CLASS_THRESHOLD) -> Column:
    """Acceleration class: > t Acceleration, < -t Deceleration, else Neutral; null -> null."""
    a = _col(c)
    return (F.when(a.isNull(), F.lit(None).cast("string"))
            .when(a > threshold, F.lit("Acceleration"))
            .when(a < -threshold, F.lit("Deceleration"))
            .otherwise(F.lit("Neutral")))


def euclidean(x1, y1, x2, y2) -> Column:
    """sqrt(dx^2 + dy^2) (SC-7)."""
    dx = _col(x1) - _col(x2)
    dy = _col(y1) - _col(y2)
    return F.sqrt(dx * dx + dy * dy)


def slugify(c) -> Column:
    """lower/trim, runs of non ``[a-z0-9]`` -> ``_``, strip ``_`` (SC-8)."""
    s = F.regexp_replace(F.lower(F.trim(_col(c))), r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def event_prefix(round_col, country_col) -> Column:
    """``r{NN}_{slug}`` (SC-9)."""
    return F.format_string("r%02d_%s", _col(round_col).cast("int"), slugify(country_col))


def driver_color(code_col, colors: dict[str, str] | None = None,
                 default: str = S.DEFAULT_COLOR) -> Column:
    """Driver code -> colour, case-insensitive, with a default (JN-10).

    The colour table is a fixed literal map (size bound: the map itself), so
    this is an in-expression lookup rather than a join.
    """
    colors = S.DRIVER_COLORS if colors is None else colors
    m = F.create_map(*[F.lit(x) for kv in colors.items() for x in kv])
    return F.coalesce(F.element_at(m, F.upper(_col(code_col).cast("string"))), F.lit(default))


def cluster_color(c, palette: list[str] | None = None) -> Column:
    """``palette[cluster mod len]`` (SC-15)."""
    palette = S.CLUSTER_PALETTE if palette is None else palette
    arr = F.array(*[F.lit(p) for p in palette])
    return F.element_at(arr, (F.pmod(_col(c).cast("int"), F.lit(len(palette))) + 1).cast("int"))


def cluster_label(c) -> Column:
    return F.concat(F.lit("Cluster "), _col(c).cast("string"))
