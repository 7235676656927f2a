"""The explanation of a model: fit on all rows, importances of its trees, sampled attributions, all under feature names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from blotter.operators import attribution
from blotter.plans.assemble import score
from blotter.plans.config import ExperimentConfig
from blotter.plans.finals import FinalModel, _prepare, train_final
from blotter.session import cut_lineage
from blotter.sources import results


@dataclass
class Explanation:
    """``attributions`` has a row per sampled row, feature and class."""

    model: FinalModel
    names: list[str]
    attributions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """Global importance of all features, and of a tree model also split counts, gains and covers."""
        found = {"shap_global_importance": attribution.global_importance(self.attributions)}
        last = self.model.pipeline.stages[-1]
        if hasattr(last, "nodes"):
            importance = attribution.tree_importance(last.nodes(self.attributions.sparkSession), self.names)
            found["tree_importance"] = importance
            for kind in ("weight", "gain", "cover"):
                found[f"top_{kind}"] = attribution.top_features(importance, kind)
        return found

    def of_class(self, category: str) -> DataFrame:
        """Attributions of one class, by its name."""
        wanted = attribution.class_id_of(category, self.model.classes)
        return attribution.class_slice(self.attributions, wanted, len(self.model.classes))

    def export(self, folder: str) -> dict[str, str]:
        return results.export_all(self.tables(), folder)


class _Last:
    """The last stage of a pipeline, scoring encoded vectors."""

    def __init__(self, stage):
        self.stages = [stage]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages[0].transform(df)


def explain(
    config: ExperimentConfig, data: DataFrame, key: str = "incident_id", size: int = attribution.SAMPLE_SIZE, permutations: int = 8
) -> Explanation:
    """Fit ``config`` on all rows and attribute the predictions of a reproducible sample of ``size`` rows."""
    model = train_final(config, data)
    *transforms, last = model.pipeline.stages
    encoders = [s for s in transforms if hasattr(s, "slot_names")]
    if not encoders:
        raise ValueError(f"{config.model_name} has no encoded features to explain")
    names = encoders[-1].slot_names()
    rows = attribution.reproducible_sample(_prepare(data, config), key, size)
    for stage in transforms:
        rows = stage.transform(rows)
    sample = cut_lineage(rows.select(key, vector_to_array("features").alias("x")))
    phi = attribution.sampled_shapley(
        sample, key, lambda df: score(_Last(last), df), len(names), len(model.classes), permutations, names=names
    )
    return Explanation(model, names, cut_lineage(phi))
