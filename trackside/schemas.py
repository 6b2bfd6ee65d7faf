"""Column names, keys, thresholds and fixed lookup values.

Values under "Fixed values" must equal the analysed project's values for the
results to agree; they are listed plainly and in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------- #
# Keys
# --------------------------------------------------------------------------- #
SESSION_KEYS: list[str] = ["Year", "Round", "SessionType"]
DRIVER_COL = "Driver"
LAP_COL = "LapNumber"
TIME_COL = "TimeInLap"
# Acceleration and other per-lap sequences partition on the car number.
LAP_SEQ_KEYS: list[str] = SESSION_KEYS + ["DriverNumber", LAP_COL]
# Summaries and lap tables group on the driver code.
LAP_KEYS: list[str] = SESSION_KEYS + [DRIVER_COL, LAP_COL]
# Tie-break column used to give samples with equal TimeInLap a total order.
SAMPLE_ID = "sample_id"

# --------------------------------------------------------------------------- #
# Fixed values (must equal the analysed project's values)
# --------------------------------------------------------------------------- #
# Canonical telemetry column order.
CANONICAL_COLUMNS: list[str] = [
    "Year", "Round", "SessionType", "DriverNumber", "Driver", "LapNumber",
    "TimeInLap", "Time", "Position", "Throttle", "Brake", "DRS", "RPM", "Speed",
    "X", "Y", "Z", "Steering", "Gear", "LapTime", "Sector1Time", "Sector2Time",
    "Sector3Time", "Compound", "FreshTyre",
]

# Kinematics
KMH_PER_MS = 3.6
ACCEL_CLIP = 15.0            # m/s^2, symmetric clip
ACCEL_CLASS_THRESHOLD = 0.5  # > 0.5 Acceleration, < -0.5 Deceleration
CORNER_MAX_DISTANCE = 500.0  # strict "<" on the distance to the corner centre

# Braking zones
MIN_BRAKE_ZONE_DURATION = 0.25  # seconds, inclusive
DECEL_THRESHOLD = -2.0          # m/s^2, braking when no brake signal
ZONE_PEAK_DECEL_THRESHOLD = -0.5

# Fastest-lap sample floors
MIN_FASTEST_LAP_SAMPLES = 50
MIN_LAP_FEATURE_SAMPLES = 20

# Lap profile windows: Speed_Pct_p averages LapPct in [p-5, p+5) for p=10..90
SPEED_PCT_POINTS: list[int] = [10, 20, 30, 40, 50, 60, 70, 80, 90]
SPEED_PCT_HALF_WIDTH = 5
# Brake share per lap third: (label, low inclusive, high exclusive)
BRAKE_THIRDS: list[tuple[str, float, float]] = [
    ("Brake_First_Third", 0.0, 33.3),
    ("Brake_Mid_Third", 33.3, 66.6),
    ("Brake_Last_Third", 66.6, 100.0),
]

# Alignment
ASOF_TOLERANCE_SECONDS = 0.2
LAP_END_FALLBACK_SECONDS = 180.0

# Preview sink: number of lines including the header line
PREVIEW_LINES = 1800

# Corner dimension (round 1): name, x range, y range, in dictionary order.
CIRCUIT_CORNERS: dict[int, list[tuple[str, tuple[float, float], tuple[float, float]]]] = {
    1: [
        ("Turn 1", (-900, -700), (-1600, -1400)),
        ("Turn 2", (-600, -400), (-1100, -900)),
        ("Turn 3-4", (-200, 100), (-600, -400)),
        ("Turn 5-6", (400, 600), (-200, 100)),
        ("Turn 7", (800, 1000), (300, 500)),
        ("Turn 8", (1200, 1400), (900, 1100)),
        ("Turn 9-10", (1500, 1700), (1300, 1500)),
        ("Turn 11", (1200, 1400), (1600, 1800)),
        ("Turn 12", (600, 800), (1700, 1900)),
        ("Turn 13", (0, 200), (1500, 1700)),
    ],
}

# Driver colours (team colours by three-letter code) and the default colour.
DRIVER_COLORS: dict[str, str] = {
    "VER": "#1B2A4A", "TSU": "#3671C6",
    "NOR": "#FF8000", "PIA": "#FF8000",
    "LEC": "#E8002D", "HAM": "#E8002D",
    "RUS": "#27F4D2", "ANT": "#27F4D2",
    "ALO": "#229971", "STR": "#229971",
    "GAS": "#0093CC", "DOO": "#0093CC", "COL": "#0093CC",
    "ALB": "#64C4FF", "SAI": "#64C4FF",
    "HUL": "#52E252", "BOR": "#52E252",
    "OCO": "#B6BABD", "BEA": "#B6BABD",
    "LAW": "#6692FF", "HAD": "#6692FF",
}
DEFAULT_COLOR = "#9AA0A6"

# Cluster colours, indexed by cluster id modulo the list length.
CLUSTER_PALETTE: list[str] = [
    "#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4",
    "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F",
]

# Radar chart spokes, in order.
RADAR_FEATURES: list[str] = [
    "Brake_Pct", "Mean_Entry_Speed", "Mean_Apex_Speed", "Mean_Exit_Speed",
    "Mean_Brake_Duration", "Mean_Peak_Decel", "Avg_Throttle", "Brake_Time_Pct",
]

# The 29 driving-style features, in order.
STYLE_FEATURE_COLUMNS: list[str] = [
    "Avg_Speed", "Max_Speed", "Avg_Throttle", "Brake_Pct", "Avg_RPM",
    "Brake_Zones", "Brake_Time_Pct",
    "Mean_Entry_Speed", "Mean_Apex_Speed", "Mean_Exit_Speed",
    "Mean_Brake_Duration", "Std_Brake_Duration",
    "Mean_Peak_Decel", "Max_Peak_Decel",
    "Sector1_Ratio", "Sector2_Ratio", "Sector3_Ratio",
    "Speed_Pct_10", "Speed_Pct_20", "Speed_Pct_30", "Speed_Pct_40",
    "Speed_Pct_50", "Speed_Pct_60", "Speed_Pct_70", "Speed_Pct_80",
    "Speed_Pct_90",
    "Brake_First_Third", "Brake_Mid_Third", "Brake_Last_Third",
]

# Clustering defaults
KMEANS_N_INIT = 10
RANDOM_STATE = 42
K_MIN, K_MAX = 3, 8
MIN_CLUSTER_DRIVERS = 3

# --------------------------------------------------------------------------- #
# Schemas
# --------------------------------------------------------------------------- #
TELEMETRY_SCHEMA = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Round", T.IntegerType()),
    T.StructField("SessionType", T.StringType()),
    T.StructField("DriverNumber", T.StringType()),
    T.StructField("Driver", T.StringType()),
    T.StructField("LapNumber", T.IntegerType()),
    T.StructField("TimeInLap", T.DoubleType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Position", T.DoubleType()),
    T.StructField("Throttle", T.DoubleType()),
    T.StructField("Brake", T.BooleanType()),
    T.StructField("DRS", T.IntegerType()),
    T.StructField("RPM", T.DoubleType()),
    T.StructField("Speed", T.DoubleType()),
    T.StructField("X", T.DoubleType()),
    T.StructField("Y", T.DoubleType()),
    T.StructField("Z", T.DoubleType()),
    T.StructField("Steering", T.DoubleType()),
    T.StructField("Gear", T.IntegerType()),
    T.StructField("LapTime", T.StringType()),
    T.StructField("Sector1Time", T.StringType()),
    T.StructField("Sector2Time", T.StringType()),
    T.StructField("Sector3Time", T.StringType()),
    T.StructField("Compound", T.StringType()),
    T.StructField("FreshTyre", T.BooleanType()),
])

CORNER_SCHEMA = T.StructType([
    T.StructField("Round", T.IntegerType(), False),
    T.StructField("corner_ord", T.IntegerType(), False),
    T.StructField("Corner", T.StringType(), False),
    T.StructField("x_lo", T.DoubleType(), False),
    T.StructField("x_hi", T.DoubleType(), False),
    T.StructField("y_lo", T.DoubleType(), False),
    T.StructField("y_hi", T.DoubleType(), False),
])


def corner_rows(rounds: dict | None = None) -> list[tuple]:
    """Flatten the corner dictionary into CORNER_SCHEMA rows."""
    rounds = CIRCUIT_CORNERS if rounds is None else rounds
    out = []
    for rnd, corners in rounds.items():
        for i, (name, (x_lo, x_hi), (y_lo, y_hi)) in enumerate(corners):
            out.append((int(rnd), i, name, float(x_lo), float(x_hi), float(y_lo), float(y_hi)))
    return out
