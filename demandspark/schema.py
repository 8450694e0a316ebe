"""Table schemas, key conventions and default parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import types as T

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("sales_quantity", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
    ]
)

PRODUCTS_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("supplier", T.StringType()),
        T.StructField("lead_time_days", T.IntegerType()),
        T.StructField("min_order_quantity", T.IntegerType()),
    ]
)

STORES_SCHEMA = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("store_name", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("size_sqft", T.IntegerType()),
        T.StructField("opening_date", T.DateType()),
    ]
)

# One panel series is one (product, store) pair; TOTAL is the single summed series.
SERIES_KEYS: tuple[str, ...] = ("product_id", "store_id")
TOTAL: tuple[str, ...] = ()

MODELS = ("arima", "prophet", "lstm")

# ---------------------------------------------------------------------------
# Defaults that results depend on. Every one is also a parameter.
# ---------------------------------------------------------------------------
FEATURE_HOLIDAYS = [
    date(2020, 1, 1),
    date(2020, 1, 20),
    date(2020, 2, 17),
    date(2020, 5, 25),
]

MODEL_HOLIDAYS = [
    date(2020, 1, 1),
    date(2020, 1, 20),
    date(2020, 2, 17),
    date(2020, 5, 25),
    date(2020, 7, 4),
    date(2020, 9, 7),
    date(2020, 10, 12),
    date(2020, 11, 11),
    date(2020, 11, 26),
    date(2020, 12, 25),
]

SPECIAL_EVENTS = [
    date(2020, 1, 15),
    date(2020, 2, 14),
    date(2020, 4, 10),
    date(2020, 7, 15),
    date(2020, 11, 27),
]

HOLIDAY_WINDOW = (-1, 1)

DESIGN_COLUMNS = [
    "is_monday",
    "is_tuesday",
    "is_wednesday",
    "is_thursday",
    "is_friday",
    "is_saturday",
    "fourier_w1",
    "fourier_w2",
    "fourier_w3",
    "fourier_w4",
    "fourier_m1",
    "fourier_m2",
    "is_holiday",
    "is_day_before_holiday",
    "is_day_after_holiday",
]

HORIZON = 7
HOLDOUT_DAYS = 7
BAND = 0.1
ENSEMBLE_WEIGHTS = {"arima": 0.33, "prophet": 0.33, "lstm": 0.34}

SERVICE_LEVEL = 0.95
SERVICE_LEVEL_Z = {0.95: 1.645, 0.99: 2.326}
ORDERING_COST = 50.0
HOLDING_COST_PCT = 0.25
UNIT_COST = 10.0
DAYS_PER_YEAR = 365

ARIMA_RUN_GRID = {"p": 2, "d": 1, "q": 2, "P": 1, "D": 1, "Q": 1}
ARIMA_DEFAULT_GRID = {"p": 3, "d": 2, "q": 3, "P": 2, "D": 1, "Q": 2}
SEASONAL_PERIOD = 7
# 5% point of the level stationarity statistic; strength of a season that asks for a seasonal difference
KPSS_LIMIT = 0.463
STRENGTH_LIMIT = 0.64

STRUCTURAL_GRID = {
    "changepoint_prior_scale": [0.001, 0.01, 0.05, 0.1, 0.5],
    "seasonality_prior_scale": [0.01, 0.1, 1.0, 10.0],
    "holidays_prior_scale": [0.01, 0.1, 1.0, 10.0],
    "seasonality_mode": ["additive", "multiplicative"],
}
STRUCTURAL_DEFAULTS = {
    "changepoint_prior_scale": 0.05,
    "seasonality_prior_scale": 10.0,
    "holidays_prior_scale": 10.0,
    "seasonality_mode": "multiplicative",
}
STRUCTURAL_REGRESSORS = [
    "temperature",
    "price_index",
    "promotion",
    "is_weekend",
    "special_event",
]

SEQUENCE_LENGTH = 7
TRAIN_FRACTION = 0.8
