"""Experiment settings, their rules and the named presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import types as T

# Accepted names.
MODEL_NAMES = (
    "dummy",
    "logistic",
    "naive_bayes",
    "random_forest",
    "xgboost",
    "extra_trees",
    "hist_gradient_boosting",
)
FOREST_CRITERIA = ("gini", "entropy", "log_loss")
FOREST_WEIGHTS = (None, "balanced", "balanced_subsample")


@dataclass(frozen=True)
class ExperimentConfig:
    """One experiment. Names and defaults are fixed values: they are result columns."""

    experiment_name: str
    model_name: str
    validation_mode: str = "temporal_cv"
    include_time_trend: bool = True
    add_cyclical: bool = True
    drop_original_cyclical: bool = False
    add_interactions: bool = True
    add_address_engineering: bool = True
    categorical_encoding: str = "onehot"
    numeric_strategy: str = "standard"
    geo_mode: str = "raw"
    n_geo_clusters: int = 40
    numeric_bins: int = 10
    sparse_output: bool = True
    logistic_l1_ratio: float = 0.0
    logistic_class_weight: str | None = None
    logistic_c: float = 0.1
    logistic_max_iter: int = 500
    logistic_tol: float = 1e-4
    logistic_solver: str = "saga"
    forest_n_estimators: int = 200
    forest_criterion: str = "log_loss"
    forest_max_depth: int | None = 24
    forest_min_samples_split: int = 2
    forest_min_samples_leaf: int = 5
    forest_max_features: str | float | None = "sqrt"
    forest_bootstrap: bool = True
    forest_class_weight: str | None = None
    forest_n_jobs: int = -1
    xgb_n_estimators: int = 300
    xgb_max_depth: int = 6
    xgb_learning_rate: float = 0.1
    xgb_subsample: float = 0.8
    xgb_colsample_bytree: float = 0.8
    xgb_min_child_weight: int = 1
    xgb_reg_alpha: float = 0.0
    xgb_reg_lambda: float = 1.0
    xgb_gamma: float = 0.0
    random_state: int = 12345

    def to_dict(self) -> dict[str, object]:
        return asdict(self)

    def but(self, **changes) -> "ExperimentConfig":
        return replace(self, **changes)

    def problems(self) -> list[str]:
        """Everything that makes the settings unusable."""
        bayes = self.model_name == "naive_bayes"
        rules = [
            (self.experiment_name.strip() != "", "experiment_name is empty"),
            (self.n_geo_clusters >= 2, "n_geo_clusters below 2"),
            (self.numeric_bins >= 2, "numeric_bins below 2"),
            (not bayes or self.categorical_encoding == "ordinal", "naive_bayes needs ordinal encoding"),
            (not bayes or self.numeric_strategy == "binned", "naive_bayes needs binned numbers"),
            (not bayes or not self.sparse_output, "naive_bayes needs dense output"),
            (
                self.model_name != "hist_gradient_boosting" or self.categorical_encoding != "onehot",
                "hist_gradient_boosting does not take one-hot columns",
            ),
            (self.logistic_c > 0, "logistic_c must be positive"),
            (self.logistic_max_iter >= 1, "logistic_max_iter below 1"),
            (self.logistic_tol > 0, "logistic_tol must be positive"),
            (0 <= self.logistic_l1_ratio <= 1, "logistic_l1_ratio outside 0..1"),
            (self.logistic_class_weight in (None, "balanced"), "logistic_class_weight unknown"),
            (self.logistic_l1_ratio <= 0 or self.logistic_solver == "saga", "an L1 part needs the saga solver"),
            (self.forest_n_estimators >= 1, "forest_n_estimators below 1"),
            (self.forest_max_depth is None or self.forest_max_depth >= 1, "forest_max_depth below 1"),
            (self.forest_min_samples_split >= 2, "forest_min_samples_split below 2"),
            (self.forest_min_samples_leaf >= 1, "forest_min_samples_leaf below 1"),
            (self.forest_criterion in FOREST_CRITERIA, "forest_criterion unknown"),
            (self.forest_class_weight in FOREST_WEIGHTS, "forest_class_weight unknown"),
            (self.xgb_gamma >= 0, "xgb_gamma is negative"),
            (self.xgb_reg_alpha >= 0, "xgb_reg_alpha is negative"),
            (self.xgb_reg_lambda >= 0, "xgb_reg_lambda is negative"),
        ]
        return [text for holds, text in rules if not holds]

    def validate(self) -> None:
        found = self.problems()
        if found:
            raise ValueError("; ".join(found))


def _spark_type(annotation: str) -> T.DataType:
    kinds = {"bool": T.BooleanType(), "int": T.IntegerType(), "float": T.DoubleType()}
    return kinds.get(annotation.split(" |")[0], T.StringType())


CONFIG_FIELDS = [T.StructField(f.name, _spark_type(f.type)) for f in fields(ExperimentConfig)]


def config_values(config: ExperimentConfig) -> dict[str, object]:
    """Values as they are stored; a mixed text/number setting becomes text."""
    values = config.to_dict()
    if values["forest_max_features"] is not None:
        values["forest_max_features"] = str(values["forest_max_features"])
    for field in CONFIG_FIELDS:
        if isinstance(field.dataType, T.DoubleType) and values[field.name] is not None:
            values[field.name] = float(values[field.name])
    return values


# --- presets: fixed values ------------------------------------------------

_BOOSTED = dict(
    model_name="xgboost",
    categorical_encoding="ordinal",
    numeric_strategy="passthrough",
    geo_mode="raw_distances",
    sparse_output=False,
)


def dummy_baseline() -> ExperimentConfig:
    return ExperimentConfig(
        "dummy_class_prior",
        "dummy",
        include_time_trend=False,
        add_cyclical=False,
        add_interactions=False,
        add_address_engineering=False,
        numeric_strategy="passthrough",
        geo_mode="none",
    )


def logistic_baseline() -> ExperimentConfig:
    return ExperimentConfig("logistic_raw_onehot_standard", "logistic", add_cyclical=False, add_interactions=False)


def logistic_original_style() -> ExperimentConfig:
    return ExperimentConfig("logistic_cyclical_interactions_geo40", "logistic", geo_mode="raw_cluster")


def logistic_finalist() -> ExperimentConfig:
    return ExperimentConfig(
        "logistic_finalist_temporal_cv", "logistic", geo_mode="raw_distances", logistic_c=0.1, logistic_max_iter=750
    )


def naive_bayes_legacy() -> ExperimentConfig:
    return ExperimentConfig(
        "naive_bayes_legacy",
        "naive_bayes",
        add_cyclical=False,
        add_interactions=False,
        categorical_encoding="ordinal",
        numeric_strategy="binned",
        geo_mode="cluster",
        sparse_output=False,
    )


def tree_baseline(model_name: str = "extra_trees") -> ExperimentConfig:
    return ExperimentConfig(
        f"{model_name}_ordinal_raw_cluster",
        model_name,
        categorical_encoding="ordinal",
        numeric_strategy="passthrough",
        geo_mode="raw_cluster",
        sparse_output=False,
    )


def random_forest_baseline() -> ExperimentConfig:
    return ExperimentConfig(experiment_name="random_forest_baseline", **{**_BOOSTED, "model_name": "random_forest"})


def xgboost_baseline() -> ExperimentConfig:
    return ExperimentConfig(
        experiment_name="xgboost_baseline", xgb_n_estimators=200, xgb_subsample=1.0, xgb_colsample_bytree=1.0, **_BOOSTED
    )


def xgboost_finalist() -> ExperimentConfig:
    return ExperimentConfig(
        experiment_name="xgboost_finalist",
        xgb_n_estimators=600,
        xgb_learning_rate=0.03,
        xgb_max_depth=8,
        xgb_min_child_weight=5,
        xgb_subsample=0.80,
        xgb_colsample_bytree=0.70,
        xgb_reg_lambda=12.0,
        **_BOOSTED,
    )


PRESETS = {
    f.__name__: f
    for f in (
        dummy_baseline,
        logistic_baseline,
        logistic_original_style,
        logistic_finalist,
        naive_bayes_legacy,
        tree_baseline,
        random_forest_baseline,
        xgboost_baseline,
        xgboost_finalist,
    )
}
