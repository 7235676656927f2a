"""Schemas of the raw, clean, feature and result tables."""

from pyspark.sql import types as T

# The column names of the raw incident file.
RAW = T.StructType(
    [
        T.StructField("Dates", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Descript", T.StringType()),
        T.StructField("DayOfWeek", T.StringType()),
        T.StructField("PdDistrict", T.StringType()),
        T.StructField("Resolution", T.StringType()),
        T.StructField("Address", T.StringType()),
        T.StructField("X", T.DoubleType()),
        T.StructField("Y", T.DoubleType()),
    ]
)

# The feature groups by their public column names.
CALENDAR = (
    "incident_year",
    "incident_month",
    "incident_day",
    "incident_hour",
    "incident_minute",
    "incident_day_of_week_num",
    "incident_day_of_year",
    "incident_week_of_year",
    "is_weekend",
)
SPATIAL = ("pd_district", "longitude", "latitude")
ADDRESS = ("street_1", "street_2", "block_number", "is_intersection")
TIME_TREND = ("datetime_numeric",)
IDENTIFIERS = ("incident_timestamp", "address")

# Cycle lengths of the periodic columns.
CYCLE_PERIODS = {
    "incident_hour": 24,
    "incident_day_of_week_num": 7,
    "incident_month": 12,
    "incident_day_of_year": 365,
}

# The columns of the modeling rows, in order.
MODELING_COLUMNS = (
    "target",
    "incident_timestamp",
    "incident_year",
    "incident_month",
    "incident_day",
    "incident_hour",
    "incident_minute",
    "incident_day_of_week_num",
    "incident_day_of_year",
    "incident_week_of_year",
    "datetime_numeric",
    "is_weekend",
    "pd_district",
    "longitude",
    "latitude",
    "address",
    "street_1",
    "street_2",
    "block_number",
    "is_intersection",
)

# Result metrics by their column names.
METRICS = ("log_loss", "accuracy", "top_3_accuracy", "macro_f1")
SUMMARY_METRICS = METRICS + ("training_seconds", "model_iterations")

# Columns a caller may carry through every layer to identify a row.
ROW_KEYS = ("incident_id",)


def missing_columns(df, required) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df, required) -> None:
    """Fail before any plan is built when a needed column is absent."""
    missing = missing_columns(df, required)
    if missing:
        raise KeyError(f"missing columns {missing}; the frame has {df.columns}")
