"""Temporal cross-validation, summaries, saved runs and exports."""

from pyspark.sql import functions as F

from blotter.operators import trends
from blotter.plans import experiments
from blotter.plans.config import dummy_baseline, naive_bayes_legacy
from blotter.session import scratch_path
from blotter.sources import fixtures, results
from workload.base import modeling, modeling_sql, query, r, rounded, with_sql
from workload.diagnostics import _CELLS, _TABLE, class_query, per_class

TS = "incident_timestamp"
YEARS = fixtures.VALIDATION_YEARS
TIMES = {"validation_years": YEARS, "test_start": fixtures.TEST_START}
SHOWN = (
    "experiment_name", "model_name", "geo_mode", "n_geo_clusters", "fold", "train_start", "train_end", "validation_start",
    "validation_end", "train_rows", "validation_rows", "log_loss", "accuracy", "top_3_accuracy", "macro_f1",
)


def prior_ctes(years=YEARS, names=("dummy_class_prior",)):
    """Fold results of the class-prior model."""
    folds = ", ".join(
        f"({i}, TIMESTAMP '{y}-01-01', TIMESTAMP '{y + 1}-01-01')" for i, y in enumerate(years, 1)
    )
    experiments_ = ", ".join(f"('{n}')" for n in names)
    return f"""{modeling_sql()},
folds(fold, lo, hi) AS (VALUES {folds}),
dev AS (SELECT target, {TS} AS ts FROM modeling WHERE {TS} < TIMESTAMP '{fixtures.TEST_START}'),
classes AS (SELECT target, row_number() OVER (ORDER BY target) AS i FROM (SELECT DISTINCT target FROM dev) u),
train AS (SELECT fold, min(ts) AS train_start, max(ts) AS train_end, count(*) AS train_rows FROM dev JOIN folds ON ts < lo GROUP BY fold),
prior AS (
 SELECT t.fold, c.target, c.i, count(d.target) / CAST(t.train_rows AS DOUBLE) AS p
 FROM train t JOIN folds f USING (fold) CROSS JOIN classes c LEFT JOIN dev d ON d.target = c.target AND d.ts < f.lo
 GROUP BY t.fold, c.target, c.i, t.train_rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p DESC, i) AS best,
  row_number() OVER (PARTITION BY fold ORDER BY p DESC, i DESC) AS place FROM prior),
val AS (SELECT f.fold, d.target, d.ts, p.p, p.best = 1 AS hit, p.place <= 3 AS top
 FROM dev d JOIN folds f ON ts >= lo AND ts < hi JOIN placed p ON p.fold = f.fold AND p.target = d.target),
scores AS (SELECT fold, min(ts) AS validation_start, max(ts) AS validation_end, count(*) AS validation_rows,
  avg(-ln(p)) AS log_loss, avg(CAST(hit AS INTEGER)) AS accuracy, avg(CAST(top AS INTEGER)) AS top_3_accuracy,
  2.0 * count(*) FILTER (WHERE hit) / (count(*) FILTER (WHERE hit) + count(*)) AS best_f1,
  count(DISTINCT target) + CASE WHEN count(*) FILTER (WHERE hit) = 0 THEN 1 ELSE 0 END AS shown_classes
 FROM val GROUP BY fold),
experiments(experiment_name) AS (VALUES {experiments_}),
results AS (
 SELECT experiment_name, 'dummy' AS model_name, 'none' AS geo_mode, 40 AS n_geo_clusters, CAST(fold AS INTEGER) AS fold,
  train_start, train_end, validation_start, validation_end, train_rows, validation_rows,
  log_loss, accuracy, top_3_accuracy, CAST(best_f1 / shown_classes AS DOUBLE) AS macro_f1
 FROM train JOIN scores USING (fold) CROSS JOIN experiments)"""


METRICS = ("log_loss", "accuracy", "top_3_accuracy", "macro_f1")
_ROUND = ", ".join(r(m, m) for m in METRICS)
_FOLD_SQL = f"SELECT * REPLACE ({', '.join(r(m, m) for m in METRICS)}) FROM results"


def prior_folds(spark, sf):
    return experiments.run_temporal_cv(dummy_baseline(), modeling(spark, sf), **TIMES)


@query("c04_prior_folds", with_sql(prior_ctes(), _FOLD_SQL))
def c04(spark, sf):
    return rounded(prior_folds(spark, sf).select(*SHOWN))


@query("c04_bayes_folds")
def c04_bayes(spark, sf):
    config = naive_bayes_legacy().but(n_geo_clusters=8)
    return rounded(experiments.run_temporal_cv(config, modeling(spark, sf), **TIMES).select(*SHOWN))


_STATS = ", ".join(
    r(f"{f}({m})", f"{m}_{n}")
    for m in METRICS
    for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)
STAT_NAMES = [f"{m}_{n}" for m in METRICS for n in ("mean", "std", "min", "max")]


@query(
    "c05_summary",
    with_sql(prior_ctes(), f"SELECT experiment_name, model_name, {_STATS} FROM results GROUP BY 1, 2"),
)
def c05(spark, sf):
    summary = experiments.summarise(prior_folds(spark, sf))
    return rounded(summary.select("experiment_name", "model_name", *STAT_NAMES))


@query("c06_run_and_save", with_sql(prior_ctes(), _FOLD_SQL))
def c06(spark, sf):
    folder = scratch_path(spark, "experiments")
    experiments.run_and_save(dummy_baseline(), modeling(spark, sf), folder, **TIMES)
    return rounded(results.read_runs(spark, folder, "folds").select(*SHOWN))


TWO = ("dummy_class_prior", "dummy_again")


@query("c07_suite", with_sql(prior_ctes(YEARS[:1], TWO), _FOLD_SQL))
def c07(spark, sf):
    configs = [dummy_baseline().but(experiment_name=n) for n in TWO]
    folds, _ = experiments.run_suite(configs, modeling(spark, sf), YEARS[:1], test_start=fixtures.TEST_START)
    return rounded(folds.select(*SHOWN))


@query("s07_saved_run", with_sql(prior_ctes(), f"SELECT 'run_one' AS run_id, * REPLACE ({_ROUND}) FROM results"))
def s07(spark, sf):
    folder = scratch_path(spark, "runs")
    folds = prior_folds(spark, sf)
    results.save_run(folder, dummy_baseline(), folds, experiments.summarise(folds), run_id="run_one")
    return rounded(results.read_runs(spark, folder, "folds").select("run_id", *SHOWN))


_OLD = ", ".join(f"NULL::DOUBLE AS {m}" for m in METRICS[2:])


@query(
    "s08_master_results",
    with_sql(
        prior_ctes(),
        f"SELECT 'new' AS run_id, * REPLACE ({_ROUND}) FROM results UNION ALL BY NAME "
        f"SELECT 'old' AS run_id, * EXCLUDE (top_3_accuracy, macro_f1) REPLACE ({', '.join(r(m, m) for m in METRICS[:2])}), {_OLD} FROM results",
    ),
)
def s08(spark, sf):
    """An older run lacks the last columns; they come back as nulls."""
    folder = scratch_path(spark, "master")
    folds = prior_folds(spark, sf)
    summary = experiments.summarise(folds)
    results.save_run(folder, dummy_baseline(), folds, summary, run_id="new")
    results.save_run(folder, dummy_baseline(), folds.drop("top_3_accuracy", "macro_f1"), summary, run_id="old")
    master, _ = results.rebuild_master(spark, folder)
    return rounded(master.select("run_id", *SHOWN))


@query("s09_dashboard_export", class_query(f"SELECT {_CELLS} FROM full_table", _TABLE))
def s09(spark, sf):
    folder = scratch_path(spark, "dashboard")
    places = results.export_all({"per_class_metrics": rounded(per_class(spark, sf).drop("f1_rank"))}, folder)
    kinds = "crime_category string, precision double, recall double, f1_score double, support bigint"
    return spark.read.schema(kinds).option("header", True).csv(places["per_class_metrics"])


_NAMES = ("prior_a", "prior_b")
_SUMS = f"SELECT experiment_name, model_name, {_STATS} FROM results GROUP BY 1, 2"


@query(
    "a13_compare_runs",
    with_sql(
        prior_ctes(names=_NAMES) + f",\nsums AS ({_SUMS})",
        "SELECT experiment_name, model_name, log_loss_mean, CAST(row_number() OVER (PARTITION BY model_name "
        "ORDER BY log_loss_mean, experiment_name) AS INTEGER) AS family_place FROM sums",
    ),
)
def a13(spark, sf):
    whole = prior_folds(spark, sf)
    both = results.stack_runs([whole.withColumn("experiment_name", F.lit(n)) for n in _NAMES])
    table = trends.compare_runs(rounded(experiments.summarise(both)))
    return table.select("experiment_name", "model_name", "log_loss_mean", "family_place")
