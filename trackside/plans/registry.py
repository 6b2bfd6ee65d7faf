"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackside.sources.adapter import ADAPTER_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, *, adapter: bool = True):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` is its oracle.

    With ``adapter=True`` the SQL may use the telemetry CTE ``tel`` and may
    start with further CTEs (``name AS (...), ...``) before a final SELECT
    separated by a line holding only ``---``.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _compose(sql, adapter)
        return fn
    return deco


def round6_sql(sql: str) -> str:
    """Render every ``round(x, 6)`` / ``round_even(x, 6)`` of oracle text as
    ``floor(x * 1e6 + 0.5) / 1e6``, the formula of ``plans.common.r6``."""
    out, i = [], 0
    pat = re.compile(r"\b(round_even|round)\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[m.end():j - 1]
        head, sep, digits = inner.rpartition(",")
        if sep and digits.strip() == "6":
            out.append(sql[i:m.start()] + f"(floor(({round6_sql(head)}) * 1000000.0 + 0.5) / 1000000.0)")
        else:
            out.append(sql[i:m.end()] + round6_sql(inner) + ")")
        i = j


def _compose(sql: str, adapter: bool) -> str:
    if "\n---\n" in sql:
        ctes, body = sql.split("\n---\n", 1)
        ctes = ctes.strip().rstrip(",")
    else:
        ctes, body = "", sql
    parts = ([ADAPTER_SQL.strip()] if adapter else []) + ([ctes] if ctes else [])
    if not parts:
        return round6_sql(body.strip())
    return round6_sql("WITH " + ",\n".join(parts) + "\n" + body.strip())


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from trackside.plans import (  # noqa: F401
        q_align,
        q_ingest,
        q_ml,
        q_scalar,
        q_season,
        q_features,
        q_kinematics,
        q_laps,
    )
