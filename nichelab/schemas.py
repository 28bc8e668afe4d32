"""Schemas of the data model and the fixed values the results depend on."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas (declared, never inferred)
# ---------------------------------------------------------------------------

OCCURRENCE = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("taxonKey", T.LongType()),
        T.StructField("decimalLatitude", T.DoubleType()),
        T.StructField("decimalLongitude", T.DoubleType()),
        T.StructField("eventDate", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("country", T.StringType()),
        T.StructField("coordinateUncertaintyInMeters", T.DoubleType()),
        T.StructField("hasCoordinate", T.BooleanType()),
        T.StructField("hasGeospatialIssue", T.BooleanType()),
        T.StructField("occurrenceStatus", T.StringType()),
    ]
)

OCCURRENCE_PAGE = T.StructType(
    [
        T.StructField("count", T.LongType()),
        T.StructField("results", T.ArrayType(OCCURRENCE)),
    ]
)

TAXON = T.StructType(
    [
        T.StructField("taxonKey", T.LongType()),
        T.StructField("matchType", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("speciesKey", T.LongType()),
        T.StructField("usageKey", T.LongType()),
    ]
)

RASTER_CELL = T.StructType(
    [
        T.StructField("var", T.IntegerType()),
        T.StructField("row_id", T.IntegerType()),
        T.StructField("col_id", T.IntegerType()),
        T.StructField("value", T.FloatType()),
    ]
)

ELEV_CELL = T.StructType(
    [
        T.StructField("row_id", T.IntegerType()),
        T.StructField("col_id", T.IntegerType()),
        T.StructField("elevation", T.DoubleType()),
    ]
)

ELEVATION_RESPONSE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("elevation", T.DoubleType()),
                        T.StructField("dataset", T.StringType()),
                        T.StructField(
                            "location",
                            T.StructType(
                                [
                                    T.StructField("lat", T.DoubleType()),
                                    T.StructField("lng", T.DoubleType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

CLIMATE_VARIABLES = ["bio1", "bio4", "bio5", "bio6", "bio12", "bio13", "bio14", "bio15"]
CLIMATE_NUMBERS = [1, 4, 5, 6, 12, 13, 14, 15]

ML_READY_COLUMNS = [
    "latitude",
    "longitude",
    "elevation",
    *CLIMATE_VARIABLES,
    "month",
    "day_of_year",
    "sin_month",
    "cos_month",
]
ML_READY_INT_COLUMNS = ["month", "day_of_year"]

ML_READY = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c in ML_READY_INT_COLUMNS else T.DoubleType())
        for c in ML_READY_COLUMNS
    ]
)

# the 13 model features (month and day_of_year are exported but not used)
FEATURE_COLUMNS = [
    "latitude",
    "longitude",
    "elevation",
    *CLIMATE_VARIABLES,
    "sin_month",
    "cos_month",
]

# completeness filter: elevation and day_of_year may stay null
REQUIRED_NON_NULL = [*CLIMATE_VARIABLES, "month", "sin_month", "cos_month"]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results
# ---------------------------------------------------------------------------

# all layers a climate source must provide, even when fewer are read
ALL_LAYERS = [f"bio{i}" for i in range(1, 20)]

# layers stored as degrees C x 10 and divided by ten on read
SCALED_BY_TEN = [1, 4, 5, 6, 7, 8, 9, 10, 11]

# occurrence filters used to build the model-ready tables
QUALITY_STATUS = "PRESENT"
DEFAULT_DATE_TO = "2024-12-31"
PIPELINE_UNCERTAINTY_MAX = 10000.0
LOCAL_COUNTRY = "ZA"
ACCEPTED_MATCH_TYPES = ["EXACT", "FUZZY"]
ACCEPTED_RANK = "SPECIES"

# elevation service
DEFAULT_ELEVATION_DATASET = "srtm30m"

# grid defaults used when a grid point has no environment value
GRID_FILL_VALUES = {
    "elevation": 500.0,
    "bio1": 1.6,
    "bio4": 35.0,
    "bio5": 2.6,
    "bio6": 0.6,
    "bio12": 750.0,
    "bio13": 120.0,
    "bio14": 20.0,
    "bio15": 55.0,
}

# named regions: (lat_min, lat_max, lon_min, lon_max)
REGIONS = {
    "western_cape": (-34.2, -33.8, 18.2, 19.0),
    "western_cape_extended": (-34.5, -32.0, 18.0, 21.0),
}
DEFAULT_REGION = "western_cape"

# clip bounds for background points
WORLD_LAT_BOUNDS = (-90.0, 90.0)
WORLD_LON_BOUNDS = (-180.0, 180.0)
LOCAL_LAT_BOUNDS = (-35.0, -22.0)
LOCAL_LON_BOUNDS = (16.0, 33.0)
BACKGROUND_GLOBAL = 500
BACKGROUND_LOCAL = 100
SEED = 42

# threshold search grid: numpy arange(0.1, 0.9, 0.01) has 80 points
# 0.1 + i * (0.11 - 0.1); the balance tolerance is 1.1
THRESHOLD_START = 0.1
THRESHOLD_STEP = 0.11 - 0.1
THRESHOLD_COUNT = 80
BALANCE_TOLERANCE = 1.1
DEFAULT_THRESHOLD = 0.5

# risk summary of the API: high > 0.7, medium (0.4, 0.7], low <= 0.4
RISK_HIGH = 0.7
RISK_MEDIUM = 0.4

# six risk categories, checked from the top: (lower bound, label, description)
RISK_CATEGORIES = [
    (0.9, "⛔ CRITICAL", "Highest invasion probability. Priority intervention required."),
    (0.8, "🟥 VERY HIGH", "Optimal conditions for invasion. Immediate management required."),
    (0.6, "🟧 HIGH", "Favorable conditions for spread. Early intervention advised."),
    (0.4, "🟨 MODERATE", "Conditions support establishment. Regular monitoring recommended."),
    (0.2, "🟩 LOW", "Low invasion potential. Monitor for occasional occurrences."),
    (None, "🟦 VERY LOW", "Minimal invasion risk. Environmental conditions not favorable."),
]

# cell colours, checked from the top: first lower bound the risk reaches wins;
# a risk below every bound gets the last colour
RISK_COLOR_BINS = [
    (0.99, "#660000"), (0.98, "#750000"), (0.97, "#850000"), (0.96, "#940000"),
    (0.95, "#A30000"), (0.94, "#B20000"), (0.93, "#C10000"), (0.92, "#D00000"),
    (0.91, "#E00000"), (0.90, "#F00000"), (0.89, "#FF0000"), (0.88, "#FF0F0F"),
    (0.87, "#FF1E1E"), (0.86, "#FF2D2D"), (0.85, "#FF3C3C"), (0.84, "#FF4B00"),
    (0.83, "#FF5500"), (0.82, "#FF6000"), (0.81, "#FF6A00"), (0.80, "#FF7500"),
    (0.78, "#FF8000"), (0.76, "#FF8A00"), (0.74, "#FF9500"), (0.72, "#FF9F00"),
    (0.70, "#FFA500"), (0.68, "#FFB000"), (0.66, "#FFBA00"), (0.64, "#FFC500"),
    (0.62, "#FFCF00"), (0.60, "#FFD700"), (0.58, "#FFE000"), (0.56, "#FFE800"),
    (0.54, "#FFF000"), (0.52, "#FFF800"), (0.50, "#FFFF00"), (0.48, "#F8FF00"),
    (0.46, "#F0FF00"), (0.44, "#E8FF00"), (0.42, "#E0FF00"), (0.40, "#D8FF00"),
    (0.38, "#CCFF00"), (0.36, "#BFFF00"), (0.34, "#B3FF00"), (0.32, "#A6FF00"),
    (0.30, "#99FF00"), (0.28, "#80FF00"), (0.26, "#66FF00"), (0.24, "#4DFF00"),
    (0.22, "#33FF00"), (0.20, "#1AFF1A"), (0.18, "#00FF33"), (0.16, "#00FF4D"),
    (0.14, "#00FF66"), (0.12, "#00FF80"), (0.10, "#00FF99"), (0.08, "#00FFB3"),
    (0.06, "#00FFCC"), (0.04, "#00FFE6"), (0.02, "#00FFFF"),
]
RISK_COLOR_FLOOR = "#00E6FF"

# legend colour scale: 11 stops at 0.0, 0.1, ..., 1.0, linear per channel in between
LEGEND_STOPS = [
    "#00E6FF", "#00FF99", "#1AFF1A", "#99FF00", "#D8FF00", "#FFFF00",
    "#FFD700", "#FFA500", "#FF7500", "#FF0000", "#660000",
]

# elevation requests carry at most this many points
ELEVATION_BATCH_SIZE = 50

# hotspot marker: darkred >= 0.9, red >= 0.8, else orange; level text likewise
HOTSPOT_COUNT = 5
HOTSPOT_LEVELS = [(0.9, "darkred", "CRITICAL"), (0.8, "red", "VERY HIGH"), (None, "orange", "HIGH")]

# navigation link of a grid cell
NAVIGATION_URL_PREFIX = "https://www.google.com/maps/dir/?api=1&destination="

# model-comparison score weights: AUC, F1, accuracy, specificity, sensitivity, AP
SCORE_WEIGHTS = {
    "auc": 0.25,
    "f1_score": 0.25,
    "accuracy": 0.15,
    "specificity": 0.15,
    "sensitivity": 0.10,
    "average_precision": 0.10,
}

# boosted trees: tuned grid and fixed settings
GBT_MAX_DEPTH_GRID = [3, 6]
GBT_STEP_SIZE = 0.1
GBT_MAX_ITER = 100
GBT_SUBSAMPLE = 0.8
GBT_FEATURE_SUBSET = "0.8"
CV_FOLDS = 3
# random-forest baseline
RF_NUM_TREES = 200
RF_MAX_DEPTH = 12
RF_MIN_LEAF = 2

TWO_PI = 2.0 * math.pi
