"""Table schemas, fixed parameter defaults and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

G = "governorate_id"
M = "month_index"

# Decimal storage types of the panel (precision, scale).
MONEY = T.DecimalType(14, 2)      # visitors, rooms, beds, forecast values
RATE = T.DecimalType(8, 4)        # occupancy fraction
INDEX = T.DecimalType(14, 4)      # stored indicators, backtest metrics
SCORE = T.DecimalType(10, 2)      # priority score and components

GOVERNORATE = T.StructType([
    T.StructField(G, T.IntegerType(), False),
    T.StructField("governorate_code", T.StringType()),
    T.StructField("governorate_name_en", T.StringType()),
    T.StructField("governorate_name_ar", T.StringType()),
])
VISITORS = T.StructType([
    T.StructField(G, T.IntegerType(), False),
    T.StructField(M, T.DateType(), False),
    T.StructField("total_visitors", MONEY),
])
ROOMS_BEDS = T.StructType([
    T.StructField(G, T.IntegerType(), False),
    T.StructField(M, T.DateType(), False),
    T.StructField("total_rooms", MONEY),
    T.StructField("total_beds", MONEY),
])
OCCUPANCY = T.StructType([
    T.StructField(G, T.IntegerType(), False),
    T.StructField(M, T.DateType(), False),
    T.StructField("average_occupancy_rate", RATE),
])
SITES = T.StructType([
    T.StructField("tourism_site_id", T.LongType(), False),
    T.StructField("site_name_en", T.StringType()),
    T.StructField("site_category", T.StringType()),
    T.StructField(G, T.IntegerType()),
    T.StructField("latitude", T.DecimalType(10, 6)),
    T.StructField("longitude", T.DecimalType(10, 6)),
])
# MultiPolygon as polygons -> rings -> points -> [lon, lat]
MULTIPOLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
BOUNDARIES = T.StructType([
    T.StructField(G, T.IntegerType(), False),
    T.StructField("governorate_code", T.StringType()),
    T.StructField("governorate_name_en", T.StringType()),
    T.StructField("boundary_coords", MULTIPOLYGON),
    T.StructField("srid", T.IntegerType()),
])
PARAMS = T.StructType([
    T.StructField("parameter_key", T.StringType(), False),
    T.StructField("parameter_value", T.StringType()),
    T.StructField("value_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])
MODEL_RUN = T.StructType([
    T.StructField("model_run_id", T.LongType(), False),
    T.StructField("model_name", T.StringType()),
    T.StructField("forecast_target", T.StringType()),
    T.StructField("horizon_months", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("run_parameters_json", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
FORECAST = T.StructType([
    T.StructField("model_run_id", T.LongType(), False),
    T.StructField(G, T.IntegerType(), False),
    T.StructField("forecast_month", T.DateType(), False),
    T.StructField("forecast_value", MONEY),
    T.StructField("lower_bound", MONEY),
    T.StructField("upper_bound", MONEY),
])
BACKTEST = T.StructType([
    T.StructField("model_run_id", T.LongType(), False),
    T.StructField(G, T.IntegerType(), False),
    T.StructField("mae", INDEX),
    T.StructField("rmse", INDEX),
    T.StructField("mape", INDEX),
    T.StructField("reliability_label", T.StringType()),
])
SCENARIOS = T.StructType([
    T.StructField("scenario_run_id", T.LongType(), False),
    T.StructField(G, T.IntegerType(), False),
    T.StructField("target_month", T.DateType(), False),
    T.StructField("additional_beds", T.IntegerType()),
    T.StructField("additional_rooms", T.IntegerType()),
    T.StructField("induced_demand_ratio", T.DecimalType(10, 4)),
    T.StructField("based_on_model_run_id", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Parameter keys and their defaults (used when a key is missing or non-numeric).
DEFAULT_PARAMS = {
    "classification_tight_threshold": 75.0,
    "classification_balanced_threshold": 45.0,
    "priority_weight_occupancy": 0.35,
    "priority_weight_growth": 0.20,
    "priority_weight_visitor_bed": 0.25,
    "priority_weight_forecast": 0.20,
}
HIGH_PRIORITY_KEY = "high_priority_threshold"
# Seeded parameter rows: key, value text, description.
SEED_PARAMS = [
    ("classification_tight_threshold", "75", "Occupancy from which a region counts as short of capacity, in percent"),
    ("classification_balanced_threshold", "45", "Occupancy from which a region counts as in balance, in percent"),
    ("priority_weight_occupancy", "0.35", "Share of the occupancy part in the score"),
    ("priority_weight_growth", "0.20", "Share of the growth part in the score"),
    ("priority_weight_visitor_bed", "0.25", "Share of the visitors-per-bed part in the score"),
    ("priority_weight_forecast", "0.20", "Share of the forecast part in the score"),
    ("high_priority_threshold", "70", "Score from which a region is reported as urgent"),
]

# Capacity classes and the justification text attached to each.
UNDER = "Under-capacity"
BALANCED = "Balanced"
OVER = "Over-capacity"
JUSTIFICATION = {
    UNDER: "Capacity expansion priority",
    BALANCED: "Seasonal management / service quality priority",
    OVER: "Demand diversification / marketing priority",
}

# Forecast models; unknown names fall back to the default.
MODELS = ("seasonal_naive", "seasonal_trend_v2")
DEFAULT_MODEL = "seasonal_trend_v2"
FORECAST_TARGET = "total_visitors"
DEFAULT_GROWTH = 0.03          # used when a series has no usable YoY pair
SIGMA_FALLBACK = 0.08          # x max(last 12 values) when no residuals
BAND_Z = 1.28                  # band half-width in sigmas
MIN_HISTORY = 13               # series with fewer rows are skipped

# Reliability labels: (min history, max mape, label), first match wins, else Low.
RELIABILITY = [(24, 12.0, "High"), (18, 20.0, "Moderate")]
RELIABILITY_ELSE = "Low"

# Scenario recommendation texts (score after vs before +-5 points).
SCENARIO_TYPE = "bed_addition"
NOTE_IMPROVES = "Capacity stress improves under the selected future baseline."
NOTE_WORSENS = "Oversupply risk may remain limited; demand assumptions dominate the result."
NOTE_MODEST = "Scenario changes are modest; monitor demand before committing large investment."
NOTE_BAND = 5.0

# Import contracts: dataset type -> required columns (first two form the
# in-file duplicate key).
REQUIRED_COLUMNS = {
    "visitors_monthly": ["governorate_id", "month_index", "total_visitors"],
    "rooms_beds_monthly": ["governorate_id", "month_index", "total_rooms", "total_beds"],
    "hotel_occupancy_monthly": ["governorate_id", "month_index", "average_occupancy_rate"],
    "admin_boundaries": ["governorate_id", "governorate_code", "governorate_name_en", "wkt"],
}
SUMMARY_COUNTERS = ["duplicates_in_file", "negative_values", "invalid_months", "null_like_values"]

# Map legend bins per metric: (lower edge, label) from the top; values below the
# last edge take the last label; NULL -> "No data".
NO_DATA = "No data"
METRIC_BINS = {
    "priority_score": [(75, "75 and above"), (60, "60–74.9"), (40, "40–59.9"), (None, "Below 40")],
    "latest_average_occupancy_rate": [(0.65, "65% and above"), (0.5, "50%–64.9%"),
                                      (0.35, "35%–49.9%"), (None, "Below 35%")],
    "visitors_per_1000_beds": [(15000, "15,000 and above"), (10000, "10,000–14,999"),
                               (5000, "5,000–9,999"), (None, "Below 5,000")],
    "next_forecast_value": [(120000, "120,000 and above"), (80000, "80,000–119,999"),
                            (50000, "50,000–79,999"), (None, "Below 50,000")],
}
# The class metric bins by its own value.
CLASS_METRIC = "capacity_classification"
PERCENT_SCALE_LIMIT = 1.5      # fractions <= this are shown x100
