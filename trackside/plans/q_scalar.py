"""Queries: scalar expressions (SC-3, SC-8, SC-9, JN-10) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside.functions import brake_numeric, driver_color, event_prefix, slugify
from trackside.plans.registry import register
from trackside.plans.sqlfrag import slug
from trackside.schemas import DEFAULT_COLOR, DRIVER_COLORS
from trackside.sources.adapter import read_table

# Brake text variants derived from event_type (each maps to 1 or 0).
BRAKE_TEXT = {"error": "True", "click": " true ", "view": "1", "signup": "0", "purchase": "1.0"}


@register("brake_numeric", """
SELECT event_id, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRAKE_TEXT.items()) + """ END AS brake_text,
       CASE WHEN lower(trim(CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRAKE_TEXT.items()) + """ END)) IN ('true', '1') THEN 1 ELSE 0 END AS brake_num
FROM events""", adapter=False)
def q_brake_numeric(spark, sf):
    ev = read_table(spark, sf, "events")
    m = F.create_map(*[F.lit(x) for kv in BRAKE_TEXT.items() for x in kv])
    t = ev.select("event_id", F.element_at(m, F.col("event_type")).alias("brake_text"))
    return t.withColumn("brake_num", brake_numeric("brake_text"))


@register("slug_prefix", f"""
SELECT n_nationkey, n_name, {slug('n_name')} AS slug,
       printf('r%02d_%s', n_nationkey, {slug('n_name')}) AS prefix FROM nation""", adapter=False)
def q_slug_prefix(spark, sf):
    n = read_table(spark, sf, "nation")
    return n.select("n_nationkey", "n_name", slugify("n_name").alias("slug"),
                    event_prefix("n_nationkey", "n_name").alias("prefix"))


# every known code, unknown ones and a lower-case one, dealt by customer key
CODES = [*DRIVER_COLORS, "ZZZ", "QQQ", next(iter(DRIVER_COLORS)).lower()]


@register("driver_colour", f"""
c AS (SELECT c_custkey, ({CODES})[c_custkey % {len(CODES)} + 1] AS code FROM customer)
---
SELECT c_custkey, code, CASE upper(code) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DRIVER_COLORS.items())
          + f" ELSE '{DEFAULT_COLOR}' END AS \"Color\" FROM c", adapter=False)
def q_driver_colour(spark, sf):
    """JN-10 over three-letter codes, known and unknown."""
    c = read_table(spark, sf, "customer")
    code = F.element_at(F.array(*[F.lit(x) for x in CODES]), (F.col("c_custkey") % len(CODES) + 1).cast("int"))
    return c.select("c_custkey", code.alias("code"), driver_color(code).alias("Color"))
