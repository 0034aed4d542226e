"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The measures of an hourly observation.
MEASURES = ["temp", "dwpt", "rhum", "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun", "coco"]

REGION = T.StructType([
    T.StructField("region_name", T.StringType(), False),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("alt", T.DoubleType()),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
])

HOURLY = T.StructType(
    [T.StructField("time", T.TimestampNTZType()), T.StructField("region_name", T.StringType())]
    + [T.StructField(m, T.IntegerType() if m == "coco" else T.DoubleType()) for m in MEASURES]
)

DAILY = T.StructType(
    HOURLY.fields + [T.StructField(c, T.DoubleType()) for c in ("tmin", "tmax", "tavg")]
)

FORECAST = T.StructType([
    T.StructField("region_id", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("predicted_value", T.DoubleType()),
    T.StructField("confidence_low", T.DoubleType()),
    T.StructField("confidence_high", T.DoubleType()),
    T.StructField("confidence_level", T.IntegerType()),
])

METRIC = T.StructType([
    T.StructField("region_id", T.StringType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
])

GEO_FEATURE = T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("zoneName", T.StringType()),
        T.StructField("countryName", T.StringType()),
    ])),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))),
    ])),
])

# Zone -> (latitude, longitude, altitude, time zone).
ZONES = {
    "US-FLA-FMPP": (28.525581, -81.536775, 0.0, "America/New_York"),
    "US-FLA-FPC": (28.996695, -82.886613, 0.0, "America/New_York"),
    "US-FLA-FPL": (27.917488, -81.450970, 0.0, "America/New_York"),
    "US-FLA-GVL": (29.619310, -82.328732, 0.0, "America/New_York"),
    "US-FLA-HST": (25.456904, -80.588092, 0.0, "America/New_York"),
    "US-FLA-JEA": (30.390902, -83.679837, 0.0, "America/New_York"),
    "US-FLA-SEC": (28.805983, -82.306291, 0.0, "America/New_York"),
    "US-FLA-TAL": (30.437174, -84.248042, 0.0, "America/New_York"),
    "US-FLA-TEC": (27.959413, -82.144821, 0.0, "America/New_York"),
    "US-SE-SOCO": (32.154182, -85.283967, 0.0, "America/Chicago"),
    "US-CAR-CPLE": (35.299120, -77.893222, 0.0, "America/New_York"),
    "US-CAR-CPLW": (35.602668, -82.602688, 0.0, "America/New_York"),
    "US-CAR-DUK": (35.222090, -81.841604, 0.0, "America/New_York"),
    "US-CAR-SC": (34.043817, -80.365381, 0.0, "America/New_York"),
    "US-CAR-SCEG": (33.514198, -81.052635, 0.0, "America/New_York"),
    "US-MIDW-AECI": (37.574031, -93.321490, 0.0, "America/Chicago"),
    "US-MIDW-LGEE": (37.589836, -85.663064, 0.0, "America/New_York"),
    "US-MIDW-MISO": (40.211376, -90.411633, 0.0, "America/Chicago"),
    "US-TEN-TVA": (35.166141, -86.702414, 0.0, "America/Chicago"),
}

# Zone prefix -> state, first match wins.
STATE_PATTERNS = [
    ("US-FLA-", "Florida"),
    ("US-CAR-", "Carolinas"),
    ("US-CAR-SC", "South Carolina"),
    ("US-CAR-SCEG", "South Carolina"),
    ("US-CAR-DUK", "North Carolina"),
    ("US-CAR-CPLE", "North Carolina"),
    ("US-CAR-CPLW", "North Carolina"),
    ("US-TEN-TVA", "Tennessee"),
    ("US-SE-", "Southeastern US"),
    ("US-SE-SOCO", "Georgia"),
    ("US-MIDW-LGEE", "Kentucky"),
    ("US-MIDW-", "Midwestern US"),
]

# Composite region -> constituent states.
COMPOSITE_STATES = {
    "Carolinas": ["North Carolina", "South Carolina"],
    "Southeastern US": ["Alabama", "Georgia", "Mississippi"],
    "Midwestern US": ["Kentucky", "Tennessee", "Virginia"],
}

# Zone prefixes where missing snow means none.
SNOW_FREE_PREFIXES = ["US-FLA", "US-SE", "US-CAR"]

# Fuels counted as renewable.
RENEWABLE_FUELS = ["SUN", "WND", "WAT", "GEO", "BIO"]

# Look-back windows of the energy series, in hours, by kind.
DEFAULT_LOOKBACK_HOURS = {
    "D": 24, "DF": 24, "DF-week": 168, "NG": 24, "TI": 24, "SR": 24, "NR": 24,
    "LMP": 72, "DAM": 24, "capacity": 720, "peak": 5 * 365 * 24,
}

# Feature lags and rolling windows (in rows) by frequency.
LAGS = {
    "15min": [1, 2, 3, 4, 96, 192, 672],
    "H": [1, 2, 3, 6, 12, 24, 168],
    "D": [1, 2, 3, 7, 14, 30],
}
ROLLING = {"15min": [4, 24, 96], "H": [6, 12, 24], "D": [7, 14, 30]}
FULL_WINDOW_LAGS = [1, 2, 3, 4, 24, 96]
FULL_WINDOW_ROLLING = [4, 24, 96]

# Seasonal period, step in seconds and clamped horizon by frequency.
SEASON = {"15min": 96, "H": 24, "D": 7}
STEP_SECONDS = {"15min": 900, "H": 3600, "D": 86400}
CLAMPED_HORIZON = {"H": 24, "D": 1}
DEFAULT_HORIZON = 96

# Two-sided normal quantiles by confidence level.
Z_VALUES = {80: 1.2815515655446004, 90: 1.6448536269514722, 95: 1.959963984540054}
