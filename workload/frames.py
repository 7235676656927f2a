"""Deterministic features, splits and class coverage."""

from pyspark.sql import functions as F

from blotter.operators import features, splits
from blotter.plans.config import dummy_baseline, logistic_baseline
from blotter.sources import fixtures
from workload.base import (
    ADDRESS_SQL,
    BASE_COLUMNS,
    CYCLE_SQL,
    CYCLES,
    PAIRS_SQL,
    development,
    frame_query,
    modeling,
    modeling_query,
    modeling_sql,
    query,
    r,
    rounded,
    with_sql,
)

KEEP = ("incident_id",)
TS = "incident_timestamp"
EARLIER = f"{TS} < TIMESTAMP '{fixtures.TEST_START}'"


@query("f01_feature_groups", modeling_query(f"SELECT incident_id, {BASE_COLUMNS}, datetime_numeric, {TS}, address FROM modeling"))
def f01(spark, sf):
    names = features.group_columns((*features.PREDICTORS, "identifiers"))
    return modeling(spark, sf).select("incident_id", *names)


_WAVES = ", ".join(r(f"{c}_{f}", f"{c}_{f}") for c in CYCLES for f in ("sin", "cos"))


@query(
    "f03_cyclical",
    modeling_query(f"SELECT incident_id, {_WAVES} FROM (SELECT incident_id, {CYCLE_SQL} FROM modeling) t"),
)
def f03(spark, sf):
    waves = features.cyclical(modeling(spark, sf), drop_original=True)
    return rounded(waves.select("incident_id", *[f"{c}_{f}" for c in CYCLES for f in ("sin", "cos")]))


def _pair(number, name):
    column = next(p.strip() for p in PAIRS_SQL.split(", ") if p.endswith(name))

    @query(f"{number}_{name}", modeling_query(f"SELECT incident_id, {column} FROM modeling"))
    def run(spark, sf):
        return features.interactions(modeling(spark, sf)).select("incident_id", name)


for _number, _name in (("f04", "district_hour"), ("f05", "district_day"), ("f06", "district_intersection")):
    _pair(_number, _name)


@query(
    "f07_coordinate_product",
    modeling_query(f"SELECT incident_id, {r('longitude * latitude', 'longitude_latitude_interaction')} FROM modeling"),
)
def f07(spark, sf):
    rows = features.interactions(modeling(spark, sf), False, False, False, coordinates=True)
    return rounded(rows.select("incident_id", "longitude_latitude_interaction"))


_STREET_PAIR, _HAS_BLOCK = ADDRESS_SQL.split(" AS street_pair, ")


@query("f08_street_pair", modeling_query(f"SELECT incident_id, {_STREET_PAIR} AS street_pair FROM modeling"))
def f08(spark, sf):
    return features.address_features(modeling(spark, sf), block_presence=False).select("incident_id", "street_pair")


@query("f09_has_block_number", modeling_query(f"SELECT incident_id, {_HAS_BLOCK} FROM modeling"))
def f09(spark, sf):
    rows = features.address_features(modeling(spark, sf), street_pair=False)
    return rows.select("incident_id", "has_block_number")


@query("f10_base_frame", modeling_query(f"SELECT incident_id, {BASE_COLUMNS}, datetime_numeric FROM modeling"))
def f10(spark, sf):
    return features.base_frame(modeling(spark, sf), keep=KEEP)


_ROUNDED_FRAME = "* EXCLUDE (target, incident_timestamp) REPLACE ({})".format(
    ", ".join(r(c, c) for c in ("longitude", "latitude", "datetime_numeric", *[f"{c}_{f}" for c in CYCLES for f in ("sin", "cos")]))
)


@query("f11_feature_frame", frame_query(f"SELECT {_ROUNDED_FRAME} FROM frame"))
def f11(spark, sf):
    return rounded(features.feature_frame(modeling(spark, sf), keep=KEEP))


@query("f12_from_config_dummy", modeling_query(f"SELECT incident_id, {BASE_COLUMNS} FROM modeling"))
def f12(spark, sf):
    return features.from_config(modeling(spark, sf), dummy_baseline(), keep=KEEP)


@query(
    "f12_from_config_logistic",
    modeling_query(f"SELECT incident_id, {BASE_COLUMNS}, datetime_numeric, {ADDRESS_SQL} FROM modeling"),
)
def f12_logistic(spark, sf):
    return features.from_config(modeling(spark, sf), logistic_baseline(), keep=KEEP)


# The arithmetic hash of the random split, in SQL.
HASH = "(((incident_id % 2147483647) * 48271 + 12345) % 2147483647 * 69621 + 12345) % 2147483647"


@query(
    "v01_random_split",
    modeling_query(
        f"SELECT incident_id, target, row_number() OVER (PARTITION BY target ORDER BY {HASH}, incident_id) "
        "<= floor(count(*) OVER (PARTITION BY target) * CAST('0.4' AS DOUBLE) + 0.5) AS is_test FROM modeling"
    ),
)
def v01(spark, sf):
    rows = modeling(spark, sf).select("incident_id", "target")
    return splits.random_split(rows, "incident_id")


@query(
    "v02_frozen_test",
    modeling_query(
        f"SELECT CASE WHEN {EARLIER} THEN 'development' ELSE 'frozen' END AS part, count(*) AS n, "
        f"min({TS}) AS first, max({TS}) AS last FROM modeling GROUP BY 1"
    ),
)
def v02(spark, sf):
    parts = splits.frozen_test(modeling(spark, sf), fixtures.TEST_START)
    tagged = [p.select(F.lit(n).alias("part"), TS) for p, n in zip(parts, ("development", "frozen"))]
    return tagged[0].unionByName(tagged[1]).groupBy("part").agg(
        F.count("*").alias("n"), F.min(TS).alias("first"), F.max(TS).alias("last")
    )


_FOLDS = "folds(fold, lo, hi) AS (VALUES " + ", ".join(
    f"({i}, TIMESTAMP '{y}-01-01', TIMESTAMP '{y + 1}-01-01')" for i, y in enumerate(fixtures.VALIDATION_YEARS, 1)
) + ")"
_USES = f"""uses AS (
 SELECT fold, CASE WHEN {TS} < lo THEN 'train' ELSE 'validation' END AS role, target, {TS} AS ts
 FROM modeling JOIN folds ON {TS} < hi WHERE {EARLIER})"""


def _fold_sql(final):
    return with_sql(f"{modeling_sql()},\n{_FOLDS},\n{_USES}", final)


@query(
    "v03_calendar_folds",
    _fold_sql("SELECT fold, role, target, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM uses GROUP BY 1, 2, 3"),
)
def v03(spark, sf):
    return splits.fold_classes(development(spark, sf), splits.calendar_folds(fixtures.VALIDATION_YEARS))


@query(
    "v04_class_coverage",
    modeling_query(
        f"""SELECT sum(a) AS reference_class_count, sum(b) AS comparison_class_count,
 coalesce(list(target ORDER BY target) FILTER (WHERE a = 1 AND b = 0), []) AS missing_from_comparison,
 coalesce(list(target ORDER BY target) FILTER (WHERE a = 0 AND b = 1), []) AS unseen_in_comparison
FROM (SELECT target, CAST(max(CASE WHEN {EARLIER} THEN 1 ELSE 0 END) AS INTEGER) AS a,
        CAST(max(CASE WHEN {EARLIER} THEN 0 ELSE 1 END) AS INTEGER) AS b
      FROM (SELECT incident_timestamp, target || CASE WHEN pd_district = 'D3' THEN '!' || incident_year ELSE '' END AS target FROM modeling) m
      GROUP BY target) t"""
    ).replace("sum(a) AS", "CAST(sum(a) AS BIGINT) AS").replace("sum(b) AS", "CAST(sum(b) AS BIGINT) AS"),
)
def v04(spark, sf):
    # One district's classes get the year attached, so that both sides have classes of their own.
    tagged = F.when(F.col("pd_district") == "D3", F.concat(F.lit("!"), F.col("incident_year"))).otherwise("")
    rows = modeling(spark, sf).select(TS, F.concat("target", tagged).alias("target"))
    before = F.col(TS) < splits.instant(fixtures.TEST_START)
    return splits.class_coverage(rows.filter(before), rows.filter(~before))


_SUMMARY = """SELECT u.fold, min(CASE WHEN role='train' THEN ts END) AS train_start,
 max(CASE WHEN role='train' THEN ts END) AS train_end, min(CASE WHEN role='validation' THEN ts END) AS validation_start,
 max(CASE WHEN role='validation' THEN ts END) AS validation_end,
 count(*) FILTER (WHERE role='train') AS train_rows, count(*) FILTER (WHERE role='validation') AS validation_rows,
 count(DISTINCT target) FILTER (WHERE role='train') AS train_classes,
 count(DISTINCT target) FILTER (WHERE role='validation') AS validation_classes,
 (SELECT count(*) FROM (SELECT DISTINCT target FROM uses v WHERE v.fold = u.fold AND role='validation'
   EXCEPT SELECT target FROM uses w WHERE w.fold = u.fold AND role='train') e) AS unseen_validation_classes
FROM uses u GROUP BY u.fold"""


@query("v05_fold_summary", _fold_sql(_SUMMARY))
def v05(spark, sf):
    return splits.summarise_folds(development(spark, sf), splits.calendar_folds(fixtures.VALIDATION_YEARS))
