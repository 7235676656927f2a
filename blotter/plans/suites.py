"""The experiment suites: each varies a few settings around a common base."""

from __future__ import annotations

from blotter.plans.config import ExperimentConfig, xgboost_baseline, xgboost_finalist


def _name(value) -> str:
    return str(value).replace(".", "_")


def _family(base: ExperimentConfig, **variants: dict) -> list[ExperimentConfig]:
    return [base.but(experiment_name=name, **changes) for name, changes in variants.items()]


_LOGISTIC = ExperimentConfig("logistic", "logistic")
_DISTANCES = _LOGISTIC.but(geo_mode="raw_distances", logistic_max_iter=750)
_TREES = xgboost_baseline()
_DEEP = _TREES.but(xgb_max_depth=8, xgb_min_child_weight=5)
_SAMPLED = _DEEP.but(xgb_subsample=0.80, xgb_colsample_bytree=0.70)


def logistic_features() -> list[ExperimentConfig]:
    """Each step switches one more feature family on."""
    steps = {
        "logistic_01_raw_baseline": {},
        "logistic_02_add_address": {"add_address_engineering": True},
        "logistic_03_add_cyclical": {"add_cyclical": True},
        "logistic_04_add_interactions": {"add_interactions": True},
        "logistic_05_add_geo40": {"geo_mode": "raw_cluster"},
    }
    current = _LOGISTIC.but(add_cyclical=False, add_interactions=False, add_address_engineering=False)
    configs = []
    for name, change in steps.items():
        current = current.but(experiment_name=name, **change)
        configs.append(current)
    return configs


def logistic_geo() -> list[ExperimentConfig]:
    return _family(
        _LOGISTIC,
        logistic_geo_raw={},
        logistic_geo_cluster20=dict(geo_mode="raw_cluster", n_geo_clusters=20),
        logistic_geo_cluster40=dict(geo_mode="raw_cluster", n_geo_clusters=40),
        logistic_geo_cluster80=dict(geo_mode="raw_cluster", n_geo_clusters=80),
        logistic_geo_distances20=dict(geo_mode="raw_distances", n_geo_clusters=20),
    )


def logistic_encoding() -> list[ExperimentConfig]:
    return _family(
        _LOGISTIC.but(geo_mode="raw_cluster"),
        logistic_encoding_onehot={},
        logistic_encoding_frequency=dict(categorical_encoding="frequency", sparse_output=False),
        logistic_encoding_ordinal=dict(categorical_encoding="ordinal", sparse_output=False),
    )


def logistic_geo_followup() -> list[ExperimentConfig]:
    return _family(
        _LOGISTIC,
        logistic_geo_raw_cluster20=dict(geo_mode="raw_cluster", n_geo_clusters=20),
        logistic_geo_raw_cluster80=dict(geo_mode="raw_cluster", n_geo_clusters=80),
        logistic_geo_cluster40_only=dict(geo_mode="cluster", n_geo_clusters=40),
        logistic_geo_raw_distances20=dict(geo_mode="raw_distances", n_geo_clusters=20),
        logistic_geo_raw_distances40=dict(geo_mode="raw_distances", n_geo_clusters=40),
    )


def logistic_encoding_followup() -> list[ExperimentConfig]:
    return _family(
        _LOGISTIC.but(geo_mode="raw_distances", sparse_output=False),
        logistic_encoding_frequency_geo_dist40=dict(categorical_encoding="frequency"),
        logistic_encoding_ordinal_geo_dist40=dict(categorical_encoding="ordinal"),
    )


def logistic_convergence() -> list[ExperimentConfig]:
    return [
        _DISTANCES.but(experiment_name=f"logistic_convergence_{n}", logistic_max_iter=n) for n in (750, 1000)
    ]


def logistic_regularization() -> list[ExperimentConfig]:
    return [
        _DISTANCES.but(experiment_name=f"logistic_c_{_name(c)}", logistic_c=c) for c in (0.01, 0.03, 0.1, 0.3, 1.0)
    ]


def logistic_elastic_net() -> list[ExperimentConfig]:
    return [
        _DISTANCES.but(experiment_name=f"logistic_elastic_net_{_name(r)}", logistic_l1_ratio=r)
        for r in (0.05, 0.10, 0.25)
    ]


def random_forest_leaves() -> list[ExperimentConfig]:
    base = _TREES.but(model_name="random_forest", forest_n_estimators=300, xgb_n_estimators=300, xgb_subsample=0.8, xgb_colsample_bytree=0.8)
    grid = ((16, 5), (16, 20), (24, 10), (24, 25), (32, 10), (32, 25), (None, 25))
    return [
        base.but(
            experiment_name=f"random_forest_depth_{depth}_leaf_{leaf}",
            forest_max_depth=depth,
            forest_min_samples_leaf=leaf,
        )
        for depth, leaf in grid
    ]


def xgboost_start() -> list[ExperimentConfig]:
    return [
        ExperimentConfig("xgboost_baseline", "xgboost", categorical_encoding="ordinal", geo_mode="raw_distances")
    ]


def xgboost_complexity() -> list[ExperimentConfig]:
    return [
        _TREES.but(experiment_name=f"xgboost_depth_{d}_child_{w}", xgb_max_depth=d, xgb_min_child_weight=w)
        for d in (4, 6, 8)
        for w in (1, 5)
    ]


def xgboost_learning_rate() -> list[ExperimentConfig]:
    return [
        _DEEP.but(experiment_name=f"xgboost_lr_{_name(eta)}_trees_{n}", xgb_learning_rate=eta, xgb_n_estimators=n)
        for eta, n in ((0.20, 100), (0.10, 200), (0.05, 400), (0.03, 600))
    ]


def xgboost_sampling() -> list[ExperimentConfig]:
    return [
        _DEEP.but(experiment_name=f"xgboost_sub_{_name(s)}_col_{_name(c)}", xgb_subsample=s, xgb_colsample_bytree=c)
        for s, c in ((0.90, 0.90), (0.80, 0.80), (0.70, 0.80), (0.80, 0.70))
    ]


def xgboost_regularization() -> list[ExperimentConfig]:
    grid = (
        (0.0, 0.0, 0.5),
        (0.0, 0.0, 2.0),
        (0.0, 0.0, 5.0),
        (0.0, 0.1, 1.0),
        (0.0, 0.5, 1.0),
        (0.1, 0.0, 1.0),
        (0.5, 0.0, 1.0),
    )
    return [
        _SAMPLED.but(
            experiment_name=f"xgboost_gamma_{_name(g)}_alpha_{_name(a)}_lambda_{_name(lam)}",
            xgb_gamma=g,
            xgb_reg_alpha=a,
            xgb_reg_lambda=lam,
        )
        for g, a, lam in grid
    ]


def xgboost_lambda() -> list[ExperimentConfig]:
    return [
        _SAMPLED.but(experiment_name=f"xgboost_lambda_{_name(lam)}", xgb_reg_lambda=lam) for lam in (3.0, 5.0, 8.0, 12.0)
    ]


# The suites by name; experiment names and grids above are fixed values too.
SUITES = {
    f.__name__: f
    for f in (
        logistic_features,
        logistic_geo,
        logistic_encoding,
        logistic_geo_followup,
        logistic_encoding_followup,
        logistic_convergence,
        logistic_regularization,
        logistic_elastic_net,
        random_forest_leaves,
        xgboost_start,
        xgboost_complexity,
        xgboost_learning_rate,
        xgboost_sampling,
        xgboost_regularization,
        xgboost_lambda,
    )
}
