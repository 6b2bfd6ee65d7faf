"""trackside: DataFrame operators for multi-session vehicle telemetry on Spark.

Every public operator is a plain function ``DataFrame -> DataFrame`` that stays
lazy (no ``collect``) and is parameterised by the session keys, so one plan
covers every session, driver and lap at once.
"""

__version__ = "0.1.0"
