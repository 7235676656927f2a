"""Raw rows to clean rows, feature rows and modeling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blotter import schema
from blotter.functions import address as addr
from blotter.functions.calendar import calendar_columns

WEST_BOUND = -122.0


def standardise(raw: DataFrame, mode: str = "intended", keep=()) -> DataFrame:
    """Rename, trim and cast; bad timestamps become null, bad numbers fail."""
    kept = [c for c in keep if c in raw.columns]
    # A stored year is the year of the instant; carried along it prunes partitions.
    stored = [c for c in ("incident_year",) if c in raw.columns and c not in kept]
    return raw.select(
        *kept,
        *stored,
        F.trim("Category").alias("category"),
        F.col("Descript").alias("descript"),
        F.trim("DayOfWeek").alias("day_of_week_name"),
        F.trim("PdDistrict").alias("pd_district"),
        F.col("Resolution").alias("resolution"),
        addr.normalise(F.col("Address"), mode).alias("address"),
        F.col("X").cast("double").alias("longitude"),
        F.col("Y").cast("double").alias("latitude"),
        F.col("Dates").try_cast("timestamp_ntz").alias("incident_timestamp"),
    )


def present(df: DataFrame, columns) -> DataFrame:
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def valid_rows(df: DataFrame) -> DataFrame:
    needed = ("category", "pd_district", "incident_timestamp", "longitude", "latitude")
    return (
        present(df, needed)
        .filter(F.col("category") != "")
        .filter(F.col("longitude") < WEST_BOUND)
    )


def clean(raw: DataFrame, mode: str = "intended", keep=()) -> DataFrame:
    return valid_rows(standardise(raw, mode, keep))


def with_features(clean_rows: DataFrame, mode: str = "intended") -> DataFrame:
    """Calendar and address columns added to the clean rows."""
    ts, day_name = F.col("incident_timestamp"), F.col("day_of_week_name")
    added = {**calendar_columns(ts, day_name), **addr.address_columns(F.col("address"), mode)}
    return clean_rows.withColumns({k: v for k, v in added.items() if k not in clean_rows.columns})


def modeling(features: DataFrame, keep=()) -> DataFrame:
    kept = [c for c in keep if c in features.columns]
    rows = features.withColumnRenamed("category", "target").select(*kept, *schema.MODELING_COLUMNS)
    return present(rows, ("target", "incident_timestamp", "longitude", "latitude"))
