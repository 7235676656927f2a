"""Assembled vectors and whole plans with settings that SQL can follow."""

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blotter.plans import assemble, config as presets, finals
from blotter.session import cached, scratch_path
from blotter.sources import fixtures
from workload.base import CLASS_COUNTS_SQL, modeling, modeling_sql, query, r, rounded, scored_sql, with_sql
from workload.diagnostics import _FOUR
from workload.modelling import _PRIORS, CLASSES, K, preset_fit
from workload.transforms import (
    _T,
    _C,
    _J,
    _TREE_MEDIANS,
    EARLY,
    FILLED,
    LEVELS,
    LIMIT,
    MEDIANS,
    NUMBERS,
    TRAIN,
    TREE_LEVELS,
    TREE_NUMBERS,
    TS,
    filled,
    frame_sql,
    rows_with,
)

SKIP = ("incident_id", TS)
DISTRICTS = tuple(f"D{i}" for i in range(10))


def vectors(spark, sf, columns, stages):
    """Key and rounded feature array of the stages fitted on the development rows."""
    rows = rows_with(spark, sf, list(columns))
    with cached(rows.filter(EARLY)) as train:
        model = Pipeline(stages=stages).fit(train)
    values = F.transform(vector_to_array("features"), lambda v: F.round(v, 6))
    return model.transform(rows).select("incident_id", values.alias("features"))


def array(cells):
    return "[" + ", ".join(f"round(CAST({c} AS DOUBLE), 6)" for c in cells) + "] AS features"


@query(
    "t20_tree_vector",
    with_sql(
        f"{frame_sql()},\n{TRAIN},\n{_TREE_MEDIANS},\n{_T},\ncoded AS (SELECT incident_id, {', '.join(f'{filled(c)} AS n_{c}' for c in TREE_NUMBERS)}, {_C} FROM frame {_J})",
        f"SELECT incident_id, {array([f'n_{c}' for c in TREE_NUMBERS] + list(TREE_LEVELS))} FROM coded",
    ),
)
def t20(spark, sf):
    """Numbers as they are, then ordinal codes."""
    return vectors(spark, sf, list(TREE_NUMBERS) + list(TREE_LEVELS), assemble.tree_transform(geo_mode="raw", skip=SKIP))


_SHARES = ",\n".join(
    f"l_{c} AS (SELECT coalesce({c}, 'UNKNOWN') AS level, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS share FROM train GROUP BY 1)" for c in LEVELS
)
_SHARED = " ".join(f"LEFT JOIN l_{c} ON coalesce(frame.{c}, 'UNKNOWN') = l_{c}.level" for c in LEVELS)
_SPREAD = "CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END"
_ROBUST = [f"({filled(c)} - (SELECT median({c}) FROM filled)) / (SELECT {_SPREAD.format(c=c)} FROM filled)" for c in NUMBERS]
_STANDARD = [f"({filled(c)} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled)" for c in NUMBERS]


@query(
    "t18_frequency_vector",
    with_sql(
        f"{frame_sql()},\n{TRAIN},\n{MEDIANS},\n{FILLED},\n{_SHARES}",
        f"SELECT incident_id, {array(_ROBUST + [f'coalesce(l_{c}.share, 0)' for c in LEVELS])} FROM frame {_SHARED}",
    ),
)
def t18(spark, sf):
    """Robustly scaled numbers, then the shares of levels."""
    return vectors(spark, sf, NUMBERS + LEVELS, assemble.logistic_transform("frequency", "robust", "raw", skip=SKIP))


@query(
    "t19_one_hot_vector",
    with_sql(
        f"{frame_sql()},\n{TRAIN},\n{MEDIANS},\n{FILLED}",
        f"SELECT incident_id, {array(_STANDARD + [f'CASE WHEN pd_district = {chr(39)}{c}{chr(39)} THEN 1 ELSE 0 END' for c in DISTRICTS])} FROM frame",
    ),
)
def t19(spark, sf):
    """Standardised numbers, then a slot per level."""
    return vectors(spark, sf, NUMBERS + ("pd_district",), assemble.logistic_transform(geo_mode="raw", skip=SKIP))


@query("m08_prior_pipeline", with_sql(modeling_sql(), f"SELECT incident_id, {_PRIORS} FROM modeling WHERE {TS} >= {LIMIT}"))
def m08(spark, sf):
    return preset_fit(spark, sf, presets.dummy_baseline())


_ALL = "counted AS (SELECT target, count(*) / CAST((SELECT count(*) FROM modeling) AS DOUBLE) AS p FROM modeling GROUP BY target)"


@query(
    "m10_final_prior",
    with_sql(
        f"{modeling_sql()},\n{_ALL},\nbest AS (SELECT *, CAST(row_number() OVER (ORDER BY p DESC, target) AS INTEGER) AS rank FROM counted)",
        f"SELECT incident_id, rank, best.target AS category, {r('p', 'probability')} FROM modeling CROSS JOIN best WHERE rank <= 3",
    ),
)
def m10(spark, sf):
    """Fit on all rows, save, load, and give the three likeliest categories per row."""
    data = modeling(spark, sf)
    path = scratch_path(spark, "final")
    finals.train_final(presets.dummy_baseline(), data).save(path)
    return rounded(finals.FinalModel.load(path).top_categories(data.select("incident_id"), k=3))


_LABEL = f"CAST(list_position({list(CLASSES)!r}, target) - 1 AS INTEGER) AS label"
_FROZEN = f"shares AS (SELECT {_PRIORS.replace('round(', 'CAST(1 AS DOUBLE) * (').replace(', 6)', ')')}),\npred AS (SELECT incident_id AS row_id, {_LABEL}, shares.* FROM modeling CROSS JOIN shares WHERE {TS} >= {LIMIT})"


@query(
    "m11_frozen_prior",
    with_sql(
        f"{modeling_sql()},\n{_FROZEN},{scored_sql()},{CLASS_COUNTS_SQL}",
        f"SELECT 'dummy_class_prior_frozen_test' AS experiment_name, log_loss, accuracy, top_3_accuracy, macro_f1, test_rows FROM {_FOUR}",
    ),
)
def m11(spark, sf):
    found = finals.evaluate_frozen(presets.dummy_baseline(), modeling(spark, sf), fixtures.TEST_START)
    return rounded(found.tables()["frozen_test_metrics"])
