"""From settings to ml pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from blotter.models.bayes import CategoricalBayes
from blotter.models.boosting import SoftmaxBoosting
from blotter.models.forest import Forest
from blotter.models.mllib import MultinomialLogistic
from blotter.models.prior import ClassPrior
from blotter.operators.encoding import ColumnEncoder
from blotter.operators.geo import N_INIT, GeoEncoder
from blotter.operators.lookup import literal
from blotter.plans.config import ExperimentConfig

CARRIED = ("target", "label", "incident_id")
TREE_MODELS = ("random_forest", "xgboost", "extra_trees", "hist_gradient_boosting")


def logistic_transform(categorical="onehot", numeric="standard", geo_mode="raw", clusters=40, sparse=True, skip=CARRIED, n_init=N_INIT):
    return _stages(geo_mode, clusters, ColumnEncoder(numeric, categorical, skip=skip, sparse=sparse), n_init)


def tree_transform(categorical="ordinal", numeric="passthrough", geo_mode="raw_cluster", clusters=40, skip=CARRIED, n_init=N_INIT):
    return _stages(geo_mode, clusters, ColumnEncoder(numeric, categorical, skip=skip, sparse=False), n_init)


def bayes_transform(bins=10, geo_mode="cluster", clusters=40, skip=CARRIED, n_init=N_INIT):
    """Binned numbers and ordinal codes moved up by one, so that unknown is 0."""
    encoder = ColumnEncoder("binned", "ordinal", bins=bins, skip=skip, output="columns", shift=1, sparse=False)
    return _stages(geo_mode, clusters, encoder, n_init)


def _stages(geo_mode: str, clusters: int, encoder: ColumnEncoder, n_init: int) -> list:
    return [GeoEncoder(geo_mode, clusters, n_init=n_init), encoder]


def transform_stages(config: ExperimentConfig, skip=CARRIED) -> list:
    config.validate()
    if config.model_name == "logistic":
        return logistic_transform(
            config.categorical_encoding,
            config.numeric_strategy,
            config.geo_mode,
            config.n_geo_clusters,
            config.sparse_output,
            skip,
        )
    if config.model_name == "naive_bayes":
        return bayes_transform(config.numeric_bins, config.geo_mode, config.n_geo_clusters, skip)
    if config.model_name in TREE_MODELS:
        return tree_transform(
            config.categorical_encoding, config.numeric_strategy, config.geo_mode, config.n_geo_clusters, skip
        )
    if config.model_name == "dummy":
        return []  # the class shares do not depend on the predictors
    raise ValueError(f"no transform for model {config.model_name!r}")


def model_stage(config: ExperimentConfig, skip=CARRIED):
    """The estimator of a model name; unknown names raise."""
    config.validate()
    c = config
    builders = {
        "dummy": lambda: ClassPrior(),
        "logistic": lambda: MultinomialLogistic(
            c.logistic_c, c.logistic_l1_ratio, c.logistic_max_iter, c.logistic_tol, c.logistic_class_weight
        ),
        "naive_bayes": lambda: CategoricalBayes(alpha=0.5, skip=skip),
        "random_forest": lambda: Forest(
            c.forest_n_estimators,
            c.forest_criterion,
            c.forest_max_depth,
            c.forest_min_samples_leaf,
            c.forest_max_features,
            c.forest_bootstrap,
            c.forest_class_weight,
            c.random_state,
            min_split=c.forest_min_samples_split,
        ),
        "extra_trees": lambda: Forest.extra(300, 2, c.random_state),
        "hist_gradient_boosting": lambda: SoftmaxBoosting.histogram(200, 0.1, 31, 0.0, c.random_state),
        "xgboost": lambda: SoftmaxBoosting(
            c.xgb_n_estimators,
            c.xgb_max_depth,
            c.xgb_learning_rate,
            c.xgb_subsample,
            c.xgb_colsample_bytree,
            c.xgb_min_child_weight,
            c.xgb_reg_alpha,
            c.xgb_reg_lambda,
            c.xgb_gamma,
            seed=c.random_state,
        ),
    }
    if c.model_name not in builders:
        raise ValueError(f"no model named {c.model_name!r}")
    return builders[c.model_name]()


def full_pipeline(config: ExperimentConfig, skip=CARRIED) -> Pipeline:
    return Pipeline(stages=[*transform_stages(config, skip), model_stage(config, skip)])


def iterations(model: PipelineModel, model_name: str | None = None) -> int | None:
    """Solver iterations of a logistic fit, rounds of a histogram boosting; null for every other model."""
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel) and last.hasSummary:
        return int(last.summary.totalIterations)
    return last.rounds if model_name == "hist_gradient_boosting" else None


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``probability`` as an array of doubles, whatever the model."""
    scored = model.transform(df)
    if isinstance(scored.schema["probability"].dataType, VectorUDT):
        scored = scored.withColumn("probability", vector_to_array("probability"))
    return scored.drop("features", "rawPrediction", "prediction")


def with_label(df: DataFrame, classes: list, target: str = "target", name: str = "label") -> DataFrame:
    """Class index in sorted order, as double; a class outside the list gives null."""
    place = F.array_position(literal(list(classes), "array<string>"), F.col(target))
    return df.withColumn(name, F.nullif((place - 1).cast("double"), F.lit(-1.0)))
