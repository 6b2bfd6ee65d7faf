"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(c) -> Column:
    """Round to 6 decimals on the binary value (floor(x*1e6 + 0.5)/1e6).

    Used on float outputs of registered queries so that Spark and the SQL
    oracle (same formula) agree bit for bit whenever their unrounded values do
    to ~1e-9; ``round``/``bround`` differ between engines at decimal ties.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * 1000000.0 + 0.5) / 1000000.0


def round6(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df
