"""Sources, cleaning projections and scalar functions."""

from pyspark.sql import functions as F

from blotter.operators import clean as cleaning
from blotter.session import scratch_path
from blotter.sources import incidents
from workload.base import (
    RAW_SQL,
    clean_sql,
    feature_sql,
    modeling,
    modeling_query,
    query,
    raw,
    with_sql,
)

# A CSV field without text is null, quoted or not, in either engine's reader.
RAW_COLUMNS = (
    '"Dates", NULLIF("Category", \'\') AS "Category", "Descript", "DayOfWeek", "PdDistrict", "Resolution", '
    '"Address", "X", "Y"'
)


@query("s01_csv_scan", with_sql(RAW_SQL, f"SELECT {RAW_COLUMNS} FROM raw"))
def s01(spark, sf):
    # Spark writes the file first, with the padding of the text fields kept.
    path = scratch_path(spark, "csv-scan")
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw(spark, sf).drop("incident_id").write.options(header=True, **kept).csv(path)
    return incidents.scan_csv(spark, path)


@query(
    "s02_raw_table",
    with_sql(RAW_SQL, 'SELECT CAST(year(TRY_CAST("Dates" AS TIMESTAMP)) AS INTEGER) AS incident_year, count(*) AS n, '
             'count("PdDistrict") AS districts FROM raw GROUP BY 1'),
)
def s02(spark, sf):
    path = scratch_path(spark, "raw-table")
    incidents.store_raw(raw(spark, sf), path)
    stored = incidents.read_raw(spark, path)
    return stored.groupBy("incident_year").agg(F.count("*").alias("n"), F.count("PdDistrict").alias("districts"))


@query("s03_layered_views", modeling_query("SELECT target, count(*) AS n FROM modeling GROUP BY target"))
def s03(spark, sf):
    names = incidents.register_views(raw(spark, sf), prefix="s03")
    return spark.sql(f"SELECT target, count(*) AS n FROM {names['modeling']} GROUP BY target")


@query("s04_row_count", modeling_query("SELECT count(*) AS modeling_rows FROM modeling"))
def s04(spark, sf):
    return modeling(spark, sf).agg(F.count("*").alias("modeling_rows"))


@query("s05_modeling_data", modeling_query("SELECT * EXCLUDE (incident_id) FROM modeling"))
def s05(spark, sf):
    names = incidents.register_views(raw(spark, sf), prefix="s05")
    return incidents.load_modeling(spark, names["modeling"])


@query(
    "s06_separate_target",
    modeling_query("SELECT target, count(*) AS n FROM modeling GROUP BY target"),
)
def s06(spark, sf):
    predictors, target = incidents.split_target(modeling(spark, sf))
    assert "target" not in predictors.columns
    return target.groupBy("target").agg(F.count("*").alias("n"))


STD = clean_sql()


def std_query(final):
    return with_sql(STD, final)


def _standard(spark, sf, mode="intended"):
    return cleaning.standardise(raw(spark, sf), mode, keep=("incident_id",))


@query(
    "p01_rename",
    std_query("SELECT incident_id, descript, resolution, longitude AS x FROM std"),
)
def p01(spark, sf):
    return _standard(spark, sf).select("incident_id", "descript", "resolution", F.col("longitude").alias("x"))


@query("p02_trim", std_query("SELECT incident_id, category, day_of_week_name, pd_district FROM std"))
def p02(spark, sf):
    return _standard(spark, sf).select("incident_id", "category", "day_of_week_name", "pd_district")


@query("p03_address_intended", std_query("SELECT incident_id, address FROM std"))
def p03(spark, sf):
    return _standard(spark, sf).select("incident_id", "address")


@query("p03_address_observed", with_sql(clean_sql("observed"), "SELECT incident_id, address FROM std"))
def p03_observed(spark, sf):
    return _standard(spark, sf, "observed").select("incident_id", "address")


@query("p04_strict_cast", std_query("SELECT incident_id, longitude, latitude FROM std"))
def p04(spark, sf):
    return _standard(spark, sf).select("incident_id", "longitude", "latitude")


@query("p05_tolerant_timestamp", std_query("SELECT incident_id, incident_timestamp FROM std"))
def p05(spark, sf):
    return _standard(spark, sf).select("incident_id", "incident_timestamp")


@query(
    "p06_not_null",
    std_query(
        "SELECT incident_id FROM std WHERE category IS NOT NULL AND pd_district IS NOT NULL "
        "AND incident_timestamp IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL"
    ),
)
def p06(spark, sf):
    needed = ("category", "pd_district", "incident_timestamp", "longitude", "latitude")
    return cleaning.present(_standard(spark, sf), needed).select("incident_id")


@query("p07_non_empty_category", std_query("SELECT incident_id, category FROM std WHERE category <> ''"))
def p07(spark, sf):
    return _standard(spark, sf).filter(F.col("category") != "").select("incident_id", "category")


@query("p08_coordinate_bound", std_query("SELECT incident_id, longitude FROM std WHERE longitude < -122"))
def p08(spark, sf):
    return _standard(spark, sf).filter(F.col("longitude") < cleaning.WEST_BOUND).select("incident_id", "longitude")


@query("p09_modeling_projection", modeling_query("SELECT * FROM modeling"))
def p09(spark, sf):
    return modeling(spark, sf)


@query(
    "p10_repeated_filter",
    with_sql(
        feature_sql(),
        "SELECT count(*) AS n, count(DISTINCT category) AS classes FROM feat WHERE category IS NOT NULL "
        "AND incident_timestamp IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL",
    ),
)
def p10(spark, sf):
    rows = modeling(spark, sf)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("target").alias("classes"))


FIELDS = {
    "d01_year": "incident_year",
    "d02_month": "incident_month",
    "d03_day": "incident_day",
    "d04_hour": "incident_hour",
    "d05_minute": "incident_minute",
    "d06_day_of_week": "incident_day_of_week_num",
    "d07_day_of_year": "incident_day_of_year",
    "d08_iso_week": "incident_week_of_year",
    "d09_epoch_seconds": "datetime_numeric",
    "d10_weekend": "is_weekend",
    "d11_intersection": "is_intersection",
    "d12_block_number": "block_number",
    "d13_street_1": "street_1",
    "d14_street_2": "street_2",
}


def _field(name, column, mode):
    @query(name, with_sql(feature_sql(mode), f"SELECT incident_id, {column} FROM feat"))
    def run(spark, sf):
        clean = cleaning.clean(raw(spark, sf), mode, keep=("incident_id",))
        return cleaning.with_features(clean, mode).select("incident_id", column)


for _name, _column in FIELDS.items():
    _field(_name, _column, "intended")
for _name in ("d11_intersection", "d12_block_number", "d13_street_1", "d14_street_2"):
    _field(f"{_name}_observed", FIELDS[_name], "observed")
