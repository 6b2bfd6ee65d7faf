"""Duration text <-> seconds.

Accepted text shapes (T5): ``'0 days 00:01:38.807000'`` and ``'0:01:38.807000'``,
fraction optional; anything else (``NaT``, ``<NA>``, empty, null) parses to null.
Formatting works on whole milliseconds / microseconds so that every engine
renders the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION_PATTERN = r"^\s*(?:(\d+) days? )?(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_duration_seconds(c) -> Column:
    """Duration text -> seconds (double); unparsable -> null."""
    s = _col(c).cast("string")
    days = F.regexp_extract(s, DURATION_PATTERN, 1)
    hours = F.regexp_extract(s, DURATION_PATTERN, 2).cast("double")
    minutes = F.regexp_extract(s, DURATION_PATTERN, 3).cast("double")
    secs = F.regexp_extract(s, DURATION_PATTERN, 4).cast("double")
    day_s = F.when(days == "", F.lit(0.0)).otherwise(days.cast("double"))
    total = day_s * 86400.0 + hours * 3600.0 + minutes * 60.0 + secs
    return F.when(s.rlike(DURATION_PATTERN), total)


def parsable_duration(c) -> Column:
    """True where the text parses as a duration (one regex match, no extraction)."""
    return _col(c).cast("string").rlike(DURATION_PATTERN)


def duration_text(micros, short: bool | Column = False) -> Column:
    """Whole microseconds (bigint) -> duration text.

    Long shape ``'D days HH:MM:SS.ffffff'``; short shape ``'H:MM:SS.ffffff'``
    (the latter when ``short`` is true; may be a boolean column).
    """
    us = _col(micros).cast("long")
    parts_long = F.format_string(
        "%d days %02d:%02d:%02d.%06d",
        F.floor(us / 86400000000).cast("long"),
        F.pmod(F.floor(us / 3600000000).cast("long"), F.lit(24)),
        F.pmod(F.floor(us / 60000000).cast("long"), F.lit(60)),
        F.pmod(F.floor(us / 1000000).cast("long"), F.lit(60)),
        F.pmod(us, F.lit(1000000)),
    )
    parts_short = F.format_string(
        "%d:%02d:%02d.%06d",
        F.floor(us / 3600000000).cast("long"),
        F.pmod(F.floor(us / 60000000).cast("long"), F.lit(60)),
        F.pmod(F.floor(us / 1000000).cast("long"), F.lit(60)),
        F.pmod(us, F.lit(1000000)),
    )
    short_c = short if isinstance(short, Column) else F.lit(bool(short))
    return F.when(us.isNull(), F.lit(None).cast("string")).when(short_c, parts_short).otherwise(parts_long)


def seconds_to_duration_text(c, short: bool | Column = False, *, zero_is_missing: bool = True) -> Column:
    """Seconds (double) -> duration text; null -> null, and 0 seconds -> null where
    ``zero_is_missing`` (lap times; a sector of 0 s is a value) (SC-14)."""
    s = _col(c)
    us = F.floor(s * 1000000.0 + 0.5).cast("long")
    missing = s.isNull() | (s == 0) if zero_is_missing else s.isNull()
    return F.when(missing, F.lit(None).cast("string")).otherwise(duration_text(us, short))


def _millis(c) -> Column:
    return F.floor(_col(c) * 1000.0 + 0.5).cast("long")


def format_laptime(c, missing: str = "—") -> Column:
    """Seconds -> ``M:SS.mmm``; null -> an em dash (SC-2)."""
    ms = _millis(c)
    text = F.format_string(
        "%d:%02d.%03d", F.floor(ms / 60000).cast("long"),
        F.pmod(F.floor(ms / 1000).cast("long"), F.lit(60)), F.pmod(ms, F.lit(1000)),
    )
    return F.when(_col(c).isNull(), F.lit(missing)).otherwise(text)


def format_gap(c, zero: str = "—") -> Column:
    """Gap seconds -> ``'+S.mmm'``; exactly 0 -> an em dash (SC-11)."""
    ms = _millis(c)
    text = F.format_string("+%d.%03d", F.floor(ms / 1000).cast("long"), F.pmod(ms, F.lit(1000)))
    return F.when(_col(c).isNull(), F.lit(None).cast("string")).when(_col(c) == 0, F.lit(zero)).otherwise(text)
