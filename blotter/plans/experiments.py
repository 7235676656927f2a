"""Temporal cross-validation, its summaries and whole suites."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F, types as T

from blotter.functions import probability as prob
from blotter.operators import features, metrics
from blotter.operators.splits import calendar_folds, fold_facts, in_period
from blotter.plans.assemble import full_pipeline, iterations, score, with_label
from blotter.plans.config import CONFIG_FIELDS, ExperimentConfig, config_values
from blotter.schema import METRICS, ROW_KEYS, SUMMARY_METRICS
from blotter.session import cached

FOLD_SCHEMA = T.StructType(
    CONFIG_FIELDS
    + [
        T.StructField("model_iterations", T.IntegerType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("train_start", T.TimestampNTZType()),
        T.StructField("train_end", T.TimestampNTZType()),
        T.StructField("validation_start", T.TimestampNTZType()),
        T.StructField("validation_end", T.TimestampNTZType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("validation_rows", T.LongType()),
        T.StructField("training_seconds", T.DoubleType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)


def fit_and_score(
    train: DataFrame, held_out: DataFrame, config: ExperimentConfig, train_classes: list, all_classes: list, empty: str
):
    """Fit on ``train`` only; returns the fitted pipeline, seconds and aligned predictions.

    ``held_out`` predictions carry ``label`` as index into ``all_classes``.
    """
    keys = [c for c in ROW_KEYS if c in train.columns]
    started = time.perf_counter()
    model = full_pipeline(config).fit(with_label(train, train_classes))
    seconds = time.perf_counter() - started
    scored = prob.align(score(model, held_out).select(*keys, "target", "probability"), train_classes, all_classes, empty)
    return model, seconds, with_label(scored, all_classes).withColumn("label", F.col("label").cast("int"))


def run_temporal_cv(
    config: ExperimentConfig,
    data: DataFrame,
    validation_years=(2011, 2012, 2013),
    test_start: str = "2014-01-01",
    ts: str = "incident_timestamp",
) -> DataFrame:
    """Metrics of one configuration on every calendar fold of the development period.

    Only fold dates, counts and metrics (one row per fold) come to the driver.
    """
    config.validate()
    folds = calendar_folds(validation_years)
    carried = [c for c in (*ROW_KEYS, "target", ts) if c in data.columns]
    if config.model_name == "dummy":
        # The class shares need no predictors.
        prepared = data.select(*dict.fromkeys(c for c in (*carried, "incident_year") if c in data.columns))
    else:
        # Row-wise features learn nothing, so they are computed once for all folds and both sides.
        prepared = features.from_config(data, config, keep=carried)
    rows = []
    with cached(prepared) as prepared:
        facts = fold_facts(prepared, folds, test_start, ts)
        all_classes = facts.classes
        year = "incident_year" if "incident_year" in prepared.columns else None
        development = prepared.filter(in_period(ts, end=test_start, year_column=year))
        for fold, record in zip(folds, facts.records):
            train, validation = fold.train(development, ts, year).drop(ts), fold.validation(development, ts, year).drop(ts)
            model, seconds, predictions = fit_and_score(
                train, validation, config, facts.train_classes[fold.fold], all_classes, "raise"
            )
            result = metrics.overall(predictions, len(all_classes), min(3, len(all_classes))).first()
            rows.append(
                {
                    **config_values(config),
                    "model_iterations": iterations(model, config.model_name),
                    **{k: record[k] for k in FOLD_SCHEMA.names if k in record},
                    "training_seconds": seconds,
                    **{m: result[m] for m in METRICS},
                }
            )
    ordered = [tuple(r[name] for name in FOLD_SCHEMA.names) for r in rows]
    return data.sparkSession.createDataFrame(ordered, FOLD_SCHEMA)


def summarise(fold_results: DataFrame, keys=("experiment_name", "model_name")) -> DataFrame:
    """Mean, sample deviation, least and largest of each metric; one fold gives a null deviation."""
    aggregates = [
        f(F.col(m)).cast("double").alias(f"{m}_{name}")
        for m in SUMMARY_METRICS
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    return fold_results.groupBy(*keys).agg(*aggregates)


def run_and_save(config: ExperimentConfig, data: DataFrame, folder: str, validation_years=(2011, 2012, 2013), **options):
    """Cross-validate, summarise, save the run and rebuild the master tables."""
    from blotter.sources import results

    folds = run_temporal_cv(config, data, validation_years, **options)
    summary = summarise(folds)
    results.save_run(folder, config, folds, summary, extra={"validation_years": list(validation_years)})
    results.rebuild_master(data.sparkSession, folder)
    return folds, summary


def run_suite(
    configs: list[ExperimentConfig],
    data: DataFrame,
    validation_years=(2011,),
    folder: str | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Several configurations over one cached modeling frame; results are stacked."""
    if not configs:
        raise ValueError("the suite is empty")
    data = data.persist()
    fold_frames, summary_frames = [], []
    try:
        for config in configs:
            if folder:
                folds, summary = run_and_save(config, data, folder, validation_years, **options)
            else:
                folds = run_temporal_cv(config, data, validation_years, **options)
                summary = summarise(folds)
            fold_frames.append(folds)
            summary_frames.append(summary)
    finally:
        data.unpersist()

    def stack(frames):
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame, allowMissingColumns=True)
        return whole

    return stack(fold_frames), stack(summary_frames)
