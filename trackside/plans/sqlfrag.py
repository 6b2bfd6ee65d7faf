"""SQL fragments mirroring ``trackside.functions`` for the DuckDB oracle."""

from __future__ import annotations

from trackside.functions.durations import DURATION_PATTERN

KEYS = '"Year", "Round", "SessionType"'
LAPK = KEYS + ', "Driver", "LapNumber"'


def parse_dur(x: str) -> str:
    p = DURATION_PATTERN.replace("'", "''")
    return (f"(CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '{p}') THEN "
            f"COALESCE(CAST(NULLIF(regexp_extract(CAST({x} AS VARCHAR), '{p}', 1), '') AS DOUBLE), 0.0) * 86400.0"
            f" + CAST(regexp_extract(CAST({x} AS VARCHAR), '{p}', 2) AS DOUBLE) * 3600.0"
            f" + CAST(regexp_extract(CAST({x} AS VARCHAR), '{p}', 3) AS DOUBLE) * 60.0"
            f" + CAST(regexp_extract(CAST({x} AS VARCHAR), '{p}', 4) AS DOUBLE) END)")


def millis(x: str) -> str:
    return f"CAST(floor(({x}) * 1000.0 + 0.5) AS BIGINT)"


def fmt_laptime(x: str) -> str:
    ms = millis(x)
    return (f"(CASE WHEN ({x}) IS NULL THEN '—' ELSE "
            f"printf('%d:%02d.%03d', {ms} // 60000, ({ms} // 1000) % 60, {ms} % 1000) END)")


def fmt_gap(x: str) -> str:
    ms = millis(x)
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 THEN '—' ELSE "
            f"printf('+%d.%03d', {ms} // 1000, {ms} % 1000) END)")


def brake_num(x: str) -> str:
    return f"COALESCE(CAST({x} AS INTEGER), 0)"


def clip(x: str, b: float = 15.0) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(-{b}, least({b}, {x})) END)"


def accel_type(x: str) -> str:
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0.5 THEN 'Acceleration' "
            f"WHEN ({x}) < -0.5 THEN 'Deceleration' ELSE 'Neutral' END)")


def slug(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), "
            f"'^_+|_+$', '', 'g')")


def r6(x: str) -> str:
    return f"round({x}, 6)"


def xmean(x: str) -> str:
    """Exact mean mirroring ``operators.common.mean(exact=True)``: each double is
    taken at its shortest decimal text, summed in DECIMAL(38,18), and the sum
    converted to the nearest double before dividing by the count."""
    return (f"(CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)"
            f" / count({x}))")
