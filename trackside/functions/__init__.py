"""Scalar column expressions (all built-in Spark functions, no Python UDFs)."""

from trackside.functions.durations import (  # noqa: F401
    duration_text,
    format_gap,
    format_laptime,
    parsable_duration,
    parse_duration_seconds,
    seconds_to_duration_text,
)
from trackside.functions.exprs import (  # noqa: F401
    accel_type,
    brake_numeric,
    clip_symmetric,
    cluster_color,
    cluster_label,
    driver_color,
    euclidean,
    event_prefix,
    slugify,
)
