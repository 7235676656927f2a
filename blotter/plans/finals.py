"""The final fit on all rows and the evaluation on the frozen period."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.operators import features, metrics
from blotter.operators.splits import MAX_CLASSES, fold_facts, in_period, now_utc
from blotter.plans.assemble import full_pipeline, score, with_label
from blotter.plans.config import ExperimentConfig
from blotter.plans.experiments import fit_and_score
from blotter.schema import ROW_KEYS
from blotter.session import bounded_rows, cached, cut_lineage
from blotter.sources import results


TOP_CLASSES = 15


def _prepare(data: DataFrame, config: ExperimentConfig) -> DataFrame:
    carried = [c for c in (*ROW_KEYS, "target") if c in data.columns]
    return features.from_config(data, config, keep=carried)


@dataclass
class FrozenEvaluation:
    """Predictions of the frozen period; every diagnostic is an aggregation over them."""

    predictions: DataFrame
    classes: list
    model: PipelineModel
    name: str

    def tables(self) -> dict[str, DataFrame]:
        n = len(self.classes)
        per_class = metrics.per_class(self.predictions, self.classes)
        whole = metrics.overall(self.predictions, n).select(F.lit(self.name).alias("experiment_name"), "*")
        return {
            "frozen_test_metrics": whole,
            "per_class_metrics": metrics.ranked(per_class),
            "calibration_bins": metrics.calibration_table(self.predictions, n).orderBy("bin"),
            "calibration_summary": metrics.calibration_summary(self.predictions, n),
            "confusion_matrix": metrics.confusion(self.predictions, n),
            "top_class_confusion": metrics.top_confusion(self.predictions, n, min(TOP_CLASSES, n)),
            "leaderboard": metrics.leaderboard(per_class),
            "reliability": metrics.reliability(metrics.calibration_table(self.predictions, n)),
            "confidence_histogram": metrics.confidence_histogram(self.predictions),
        }

    def export(self, folder: str) -> dict[str, str]:
        """All tables as CSV below ``folder``; gives their places."""
        return results.export_all(self.tables(), folder)


def evaluate_frozen(
    config: ExperimentConfig, data: DataFrame, test_start: str = "2014-01-01", materialise: bool = True
) -> FrozenEvaluation:
    """Fit on the development period, score the frozen one.

    Classes are those of *all* rows; a class without training rows gets 0.
    """
    facts = fold_facts(data, [], test_start)  # raises when either period is empty
    year = "incident_year" if "incident_year" in data.columns else None
    development = data.filter(in_period(end=test_start, year_column=year))
    frozen = data.filter(in_period(start=test_start, year_column=year))
    with cached(_prepare(development, config)) as train:
        model, _, predictions = fit_and_score(
            train, _prepare(frozen, config), config, facts.classes, facts.all_classes, "uniform"
        )
    if materialise:  # many diagnostics follow: score once, keep the table
        predictions = cut_lineage(predictions)
    return FrozenEvaluation(predictions, facts.all_classes, model, f"{config.experiment_name}_frozen_test")


@dataclass
class FinalModel:
    pipeline: PipelineModel
    classes: list
    metadata: dict

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        row = spark.range(1).select(F.lit(json.dumps(self.metadata)).alias("value"))
        row.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "FinalModel":
        spark = SparkSession.active()
        metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        return cls(PipelineModel.load(f"{path}/pipeline"), metadata["classes"], metadata)

    def predict(self, features_frame: DataFrame) -> DataFrame:
        return score(self.pipeline, features_frame)

    def top_categories(self, features_frame: DataFrame, key: str = "incident_id", k: int = 3) -> DataFrame:
        """The k most likely categories per row, ranked."""
        names = F.array(*[F.lit(c) for c in self.classes])
        pairs = F.transform(
            F.col("probability"),
            lambda p, i: F.struct((-p).alias("o"), i.alias("i"), p.alias("p")),
        )
        best = F.slice(F.array_sort(pairs), 1, k)
        ranked = self.predict(features_frame).select(key, F.posexplode(best).alias("pos", "e"))
        return ranked.select(
            key,
            (F.col("pos") + 1).alias("rank"),
            F.element_at(names, F.col("e.i") + 1).alias("category"),
            F.col("e.p").alias("probability"),
        )


def metadata_row(data: DataFrame, config: ExperimentConfig, evaluation: dict | None = None) -> dict:
    """Counts, classes, settings and - when an evaluation is given - its metrics."""
    counted = bounded_rows(data.groupBy("target").agg(F.count("*").alias("n")), MAX_CLASSES, "classes")
    classes, rows = sorted(r["target"] for r in counted), sum(r["n"] for r in counted)
    frame = _prepare(data, config)
    carried = [c for c in (*ROW_KEYS, "target") if c in frame.columns]
    return {
        "model_name": config.experiment_name,
        "trained_at_utc": now_utc().isoformat(),
        "training_rows": rows,
        "raw_feature_rows": rows,
        "raw_feature_columns": len(frame.columns) - len(carried),
        "class_count": len(classes),
        "classes": classes,
        "config": config.to_dict(),
        **(evaluation or {}),
    }


def train_final(config: ExperimentConfig, data: DataFrame, evaluation: dict | None = None) -> FinalModel:
    """Fit on all rows, the frozen period included."""
    metadata = metadata_row(data, config, evaluation)
    with cached(with_label(_prepare(data, config), metadata["classes"])) as train:
        pipeline = full_pipeline(config).fit(train)
    encoders = [s for s in pipeline.stages if hasattr(s, "encoded_columns")]
    if encoders:
        metadata["transformed_feature_columns"] = encoders[0].width()
    return FinalModel(pipeline, metadata["classes"], metadata)
