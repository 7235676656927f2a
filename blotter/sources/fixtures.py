"""Incident-shaped views over the test tables, so that every operator has input.

The incident file itself is not available; these rules turn orders into raw
incident rows, and into prediction rows with exact ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CLASSES = [f"C{i}" for i in range(7)]
TEST_START = "2001-01-01"
VALIDATION_YEARS = (1998, 1999, 2000)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The needed columns of a table, dealt out to the session's shuffle partitions.

    The test tables have a single row group each and would be read by one task.
    """
    return table(spark, folder, name).select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def raw_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One raw row per order: padded, empty and missing values at fixed key patterns."""
    orders = spread_table(spark, folder, "orders", "o_orderkey", "o_orderdate")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    k = F.col("k")
    text = lambda c: c.cast("string")
    return orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderdate") + minutes).alias("ts")).select(
        k.cast("bigint").alias("incident_id"),
        F.when(k % 1301 == 0, "bad date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Dates"),
        F.when(k % 1499 == 0, "")
        .when((k * 7) % 10 < 6, F.concat(F.lit(" C"), text(F.expr("(k % 1440) div 288")), F.lit(" ")))
        .otherwise(F.concat(F.lit("C"), text(k * 31 % 7)))
        .alias("Category"),
        F.concat(F.lit("desc "), text(k % 11)).alias("Descript"),
        F.date_format("ts", "EEEE").alias("DayOfWeek"),
        F.when(k % 1201 == 0, None).otherwise(F.concat(F.lit("D"), text(k % 10))).alias("PdDistrict"),
        F.when(k % 2 == 0, "NONE").otherwise("ARREST").alias("Resolution"),
        F.when(k % 3 == 0, F.concat(F.lit("S"), text(k % 40), F.lit(" ST / S"), text(k % 23 + 40), F.lit(" AV")))
        .when(k % 3 == 1, F.concat(text((k % 30) * 100), F.lit(" Block of S"), text(k % 40), F.lit(" ST")))
        .otherwise(F.concat(F.lit("S"), text(k % 40), F.lit(" ST/S"), text(k % 23 + 40), F.lit(" AV")))
        .alias("Address"),
        F.when(k % 997 == 0, F.lit(-120.5))
        .otherwise(F.lit(-122.52) + ((k * 37) % 1400).cast("double") / F.lit(10000.0))
        .alias("X"),
        F.when(k % 1009 == 0, None)
        .otherwise(F.lit(37.70) + ((k * 53) % 1200).cast("double") / F.lit(10000.0))
        .alias("Y"),
    )


def predictions(spark: SparkSession, folder: str, zero_every: int | None = None) -> DataFrame:
    """Row, label and seven probabilities from integer weights.

    ``zero_every`` gives every n-th row an all-zero array, to exercise the
    rules for rows without any probability.
    """
    key = F.col("o_orderkey")
    weights = [(F.lit(1) + (key * (13 + 7 * i) + 31 * i) % 97).cast("double") for i in range(7)]
    size = weights[0]
    for w in weights[1:]:
        size = size + w
    shares = [w / size for w in weights]
    if zero_every:
        shares = [F.when(key % zero_every == 0, F.lit(0.0)).otherwise(s) for s in shares]
    return spread_table(spark, folder, "orders", "o_orderkey").select(
        key.alias("row_id"), (key * 31 % 7).cast("int").alias("label"), F.array(*shares).alias("probability")
    )


def centers(n: int = 8) -> list[tuple[float, float]]:
    return [(-122.52 + 0.0175 * i, 37.70 + 0.015 * ((i * 3) % n)) for i in range(n)]


def contributions(spark: SparkSession, folder: str, features: int = 10, classes: int = 7) -> DataFrame:
    """A contribution per order, feature and class."""
    key = F.col("o_orderkey")
    cells = ", ".join(
        f"named_struct('feature', 'f{f}', 'class_id', {c}, "
        f"'phi', double((o_orderkey * {f + 3} + {17 * c}) % 101 - 50) / 100D)"
        for f in range(features)
        for c in range(classes)
    )
    rows = spread_table(spark, folder, "orders", "o_orderkey")
    return rows.select(key.alias("row_id"), F.expr(f"explode(array({cells}))").alias("e")).select("row_id", "e.*")
