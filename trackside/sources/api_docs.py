"""Landed API documents (SRC-4): one folder per endpoint, JSON with explicit schemas.

HTTP fetching is not part of this library; documents are landed first
(``<root>/endpoint=<name>/...json``). ``land_documents`` turns array documents, which one
task must read as a whole, into JSON lines once; ``read_documents`` reads lines in parallel.
What does not parse is returned as rejects by both, with the file and the text. A
missing endpoint folder gives empty frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside.sources.files import path_exists

_L, _I, _D, _S, _B, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_AI = T.ArrayType(_I)
_SESSION = (("meeting_key", _L), ("session_key", _L))
_DRIVER = (*_SESSION, ("driver_number", _I))

# Fields of the public API's documents (fixed values). Values that come as a number or
# as a list, depending on the session, are kept as text.
ENDPOINT_SCHEMAS: dict[str, T.StructType] = {
    "meetings": _st(("meeting_key", _L), ("meeting_name", _S), ("meeting_official_name", _S), ("year", _I),
                    ("country_key", _I), ("country_code", _S), ("country_name", _S), ("location", _S),
                    ("circuit_key", _I), ("circuit_short_name", _S), ("date_start", _TS), ("date_end", _TS),
                    ("gmt_offset", _S)),
    "sessions": _st(*_SESSION, ("session_name", _S), ("session_type", _S), ("year", _I), ("country_key", _I),
                    ("country_code", _S), ("country_name", _S), ("location", _S), ("circuit_key", _I),
                    ("circuit_short_name", _S), ("date_start", _TS), ("date_end", _TS), ("gmt_offset", _S)),
    "drivers": _st(*_DRIVER, ("name_acronym", _S), ("broadcast_name", _S), ("first_name", _S), ("last_name", _S),
                   ("full_name", _S), ("team_name", _S), ("team_colour", _S), ("country_code", _S), ("headshot_url", _S)),
    "laps": _st(*_DRIVER, ("lap_number", _I), ("date_start", _TS), ("lap_duration", _D), ("duration_sector_1", _D),
                ("duration_sector_2", _D), ("duration_sector_3", _D), ("is_pit_out_lap", _B), ("i1_speed", _I),
                ("i2_speed", _I), ("st_speed", _I), ("segments_sector_1", _AI), ("segments_sector_2", _AI),
                ("segments_sector_3", _AI)),
    "stints": _st(*_DRIVER, ("stint_number", _I), ("lap_start", _I), ("lap_end", _I), ("compound", _S),
                  ("tyre_age_at_start", _I)),
    "car_data": _st(*_DRIVER, ("date", _TS), ("throttle", _D), ("brake", _D), ("drs", _I), ("rpm", _D), ("speed", _D),
                    ("n_gear", _I)),
    "location": _st(*_DRIVER, ("date", _TS), ("x", _D), ("y", _D), ("z", _D)),
    "championship_drivers": _st(*_DRIVER, ("points_start", _D), ("points_current", _D), ("position_start", _I),
                                ("position_current", _I)),
    "championship_teams": _st(*_SESSION, ("team_name", _S), ("points_start", _D), ("points_current", _D),
                              ("position_start", _I), ("position_current", _I)),
    "starting_grid": _st(*_DRIVER, ("position", _I), ("lap_duration", _D)),
    "session_result": _st(*_DRIVER, ("position", _I), ("number_of_laps", _I), ("points", _D), ("dnf", _B), ("dns", _B),
                          ("dsq", _B), ("duration", _S), ("gap_to_leader", _S)),
    "pit": _st(*_DRIVER, ("lap_number", _I), ("date", _TS), ("pit_duration", _D), ("lane_duration", _D),
               ("stop_duration", _D)),
    "overtakes": _st(*_SESSION, ("date", _TS), ("overtaking_driver_number", _I), ("overtaken_driver_number", _I),
                     ("position", _I)),
    "weather": _st(*_SESSION, ("date", _TS), ("air_temperature", _D), ("track_temperature", _D), ("humidity", _D),
                   ("pressure", _D), ("rainfall", _I), ("wind_direction", _I), ("wind_speed", _D)),
}


def read_endpoint(spark: SparkSession, root: str, endpoint: str,
                  schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """Read one endpoint's landed documents (all sessions at once).

    ``multiline`` documents (JSON arrays) are one task per file; land the sample
    endpoints as JSON lines and pass ``multiline=False``, then files are split."""
    schema = schema or ENDPOINT_SCHEMAS[endpoint]
    path = f"{root.rstrip('/')}/endpoint={endpoint}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema).option("multiLine", multiline)
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX").json(path))


REJECTS = "endpoint string, file string, document string, reason string"
CORRUPT = "_corrupt_record"
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "columnNameOfCorruptRecord": CORRUPT,
                "mode": "PERMISSIVE"}


def endpoint_path(root: str, endpoint: str) -> str:
    return f"{root.rstrip('/')}/endpoint={endpoint}"


def _texts(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    return spark.read.text(path, wholetext=whole).select(
        F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text")).filter("text <> ''")


def _rejected(df: DataFrame, endpoint: str, text: Column, reason: str) -> DataFrame:
    return df.select(F.lit(endpoint).alias("endpoint"), "file", text.alias("document"), F.lit(reason).alias("reason"))


def split_arrays(texts: DataFrame, endpoint: str) -> tuple[DataFrame, DataFrame]:
    """(file, text) documents -> (file, line): one object a line, and rejects: documents that are
    neither an object nor an array of objects."""
    array = F.from_json("text", "array<string>")
    parsed = texts.withColumn("objects", F.when(F.startswith("text", F.lit("[")), array).otherwise(F.array("text")))
    lines = parsed.select("file", F.explode("objects").alias("line"))
    is_object = F.coalesce(F.startswith(F.trim("line"), F.lit("{")), F.lit(False))
    bad = _rejected(parsed.filter(F.col("objects").isNull()), endpoint, F.col("text"), "document").unionByName(
        _rejected(lines.filter(~is_object), endpoint, F.col("line"), "not_an_object"))
    return lines.filter(is_object), bad


def parse_lines(lines: DataFrame, endpoint: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, line) -> rows of the endpoint's schema, and rejects: lines that are no JSON or have a
    value of another type (such a row is not stored with a null in its place)."""
    schema = schema or ENDPOINT_SCHEMAS[endpoint]
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select("file", "line", F.from_json("line", full, JSON_OPTIONS).alias("d"))
    broken = F.col(f"d.{CORRUPT}").isNotNull() | F.col("d").isNull()
    return (parsed.filter(~broken).select(*[F.col(f"d.{f.name}").alias(f.name) for f in schema.fields]),
            _rejected(parsed.filter(broken), endpoint, F.col("line"), "row"))


def land_documents(spark: SparkSession, source: str, root: str, endpoint: str, *, whole_files: bool = True) -> DataFrame:
    """Documents below ``source`` (files of one document each, or with ``whole_files=False`` one document
    a line) -> JSON lines in the endpoint's folder, which any number of tasks can read. Returns the rejects,
    which are also kept below ``<root>/quarantine``. Landing again replaces the endpoint's lines."""
    lines, bad = split_arrays(_texts(spark, source, whole_files), endpoint)
    lines.select("line").write.mode("overwrite").text(endpoint_path(root, endpoint))
    kept = f"{root.rstrip('/')}/quarantine/endpoint={endpoint}"
    bad.drop("endpoint").write.mode("overwrite").parquet(kept)
    return spark.read.schema(REJECTS.replace("endpoint string, ", "")).parquet(kept).select(F.lit(endpoint).alias("endpoint"), "*")


def read_documents(spark: SparkSession, root: str, endpoint: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of one endpoint's landed JSON lines; a line may also hold an array."""
    schema = schema or ENDPOINT_SCHEMAS[endpoint]
    path = endpoint_path(root, endpoint)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECTS)
    lines, bad = split_arrays(_texts(spark, path, False), endpoint)
    rows, broken = parse_lines(lines, endpoint, schema)
    return rows, bad.unionByName(broken)
