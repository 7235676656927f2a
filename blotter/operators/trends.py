"""Exploratory volumes: by calendar unit, by category, by place, and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# The calendar units and the feature columns that carry them.
UNITS = {
    "hour": "incident_hour",
    "day": "incident_day_of_week_num",
    "week": "incident_week_of_year",
    "month": "incident_month",
    "year": "incident_year",
}


def volume(df: DataFrame, unit: str, columns: dict[str, str] = UNITS) -> DataFrame:
    return df.groupBy(F.col(columns[unit]).alias(unit)).agg(F.count("*").alias("incidents"))


def volume_by_category(df: DataFrame, unit: str, category: str = "target", columns: dict[str, str] = UNITS) -> DataFrame:
    return df.groupBy(F.col(category).alias("category"), F.col(columns[unit]).alias(unit)).agg(
        F.count("*").alias("incidents")
    )


def all_volumes(df: DataFrame, category: str = "target", columns: dict[str, str] = UNITS) -> DataFrame:
    """Every unit per category in long form from one scan.

    Each row yields one (unit, value) entry per unit; the entries are combined
    within the task before the shuffle.
    """
    entries = F.array(
        *[F.struct(F.lit(u).alias("unit"), F.col(c).cast("int").alias("value")) for u, c in columns.items()]
    )
    return (
        df.select(F.col(category).alias("category"), F.explode(entries).alias("e"))
        .groupBy("category", F.col("e.unit").alias("unit"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("incidents"))
    )


def density(df: DataFrame, step: float = 0.01, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Incidents per square grid cell."""
    return df.groupBy(
        F.floor(F.col(lon) / F.lit(step)).alias("cell_x"), F.floor(F.col(lat) / F.lit(step)).alias("cell_y")
    ).agg(F.count("*").alias("incidents"))


def district_mix(df: DataFrame, district: str = "pd_district", category: str = "target") -> DataFrame:
    """Category counts and shares within each district; the window runs over the counts."""
    counts = df.groupBy(F.col(district).alias("district"), F.col(category).alias("category")).agg(
        F.count("*").alias("incidents")
    )
    return counts.withColumn("share", F.col("incidents") / F.sum("incidents").over(Window.partitionBy("district")))


def compare_runs(summary: DataFrame, key=("model_name",)) -> DataFrame:
    """Runs by mean log loss, with their place inside the model family."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy("log_loss_mean", "experiment_name"))
    return summary.withColumn("family_place", place)
