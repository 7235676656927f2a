"""Classifiers against brute force, against each other, and after saving."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blotter.models.bayes import CategoricalBayes
from blotter.models.boosting import SoftmaxBoosting, leaf_value
from blotter.models.forest import Forest
from blotter.models.mllib import MultinomialLogistic
from blotter.models.prior import ClassPrior
from blotter.operators import attribution, metrics
from blotter.operators.encoding import ColumnEncoder
from blotter.operators.geo import GeoEncoder
from blotter.plans import assemble, config, experiments, explanation, finals
from blotter.session import cut_lineage
from blotter.sources import fixtures, results
from workload.base import modeling
from workload.modelling import CLASSES, EARLY, small_rows


def bayes_by_hand(train, row, classes, alpha=0.5):
    n_codes = [max(codes) + 1 for codes in zip(*[x for _, x in train])]
    sizes = Counter(k for k, _ in train)
    joint = []
    for k in range(classes):
        total = math.log(sizes[k] / len(train))
        for j, code in enumerate(row):
            hits = sum(1 for y, x in train if y == k and x[j] == code)
            total += math.log((hits + alpha) / (sizes[k] + alpha * n_codes[j]))
        joint.append(total)
    e = np.exp(np.array(joint) - max(joint))
    return e / e.sum()


@pytest.mark.parametrize("inline", [64, 0])
def test_naive_bayes(spark, inline, monkeypatch):
    monkeypatch.setattr("blotter.models.bayes.INLINE_CODES", inline)
    train = [(i % 3, (i % 4, (i * i) % 5)) for i in range(60)]
    frame = spark.createDataFrame([(float(k), *x) for k, x in train], "label double, a int, b int")
    model = CategoricalBayes(["a", "b"]).fit(frame)
    rows = [(0, 0), (3, 4), (1, 2), (0, 3)]
    got = model.transform(spark.createDataFrame(rows, "a int, b int")).collect()
    for r in got:
        assert r["probability"] == pytest.approx(bayes_by_hand(train, (r["a"], r["b"]), 3))


def test_leaf_value():
    assert leaf_value(-4.0, 2.0, 0.0, 2.0) == 1.0
    assert leaf_value(-4.0, 2.0, 1.0, 1.0) == 1.0
    assert leaf_value(0.5, 2.0, 1.0, 1.0) == 0.0


@pytest.fixture(scope="module")
def split(spark, small):
    """Encoded train and validation rows; the minute of the day predicts 60 % of the classes."""
    rows = small_rows(spark, small).drop("pd_district")
    train = assemble.with_label(rows.filter(EARLY), CLASSES).drop("target", "incident_timestamp")
    held = assemble.with_label(rows.filter(~F.expr(EARLY)), CLASSES).drop("target", "incident_timestamp")
    encoder = ColumnEncoder("standard", "ordinal", sparse=False).fit(train)
    return cut_lineage(encoder.transform(train)), cut_lineage(encoder.transform(held))


def loss(model, rows):
    class One:
        def transform(self, df):
            return model.transform(df)

    scored = assemble.score(One(), rows)
    total = scored.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    return metrics.log_loss(scored).first()[0]


def test_planted_signal(spark, split, tmp_path):
    train, held = split
    prior = loss(ClassPrior().fit(train), held)
    logistic = loss(MultinomialLogistic(c=1.0, max_iter=40).fit(train), held)
    forest = loss(Forest(trees=10, max_depth=6).fit(train), held)
    booster = SoftmaxBoosting(rounds=4, depth=4, eta=0.5, subsample=0.9, colsample=0.9, checkpoint_every=2).fit(train)
    boosted = loss(booster, held)
    assert boosted < logistic < prior
    assert forest < prior

    path = str(tmp_path / "booster")
    booster.write().overwrite().save(path)
    again = type(booster).load(path)
    a, b = (
        {r["incident_id"]: r["probability"] for r in m.transform(held).collect()} for m in (booster, again)
    )
    assert a == b
    importance = attribution.tree_importance(again.nodes(spark))
    assert importance.orderBy(F.desc("weight")).first()["feature"] in ("f0", "f1")


def test_boosting_step_by_hand(spark):
    """One round, one split: the leaf values are Newton steps of the softmax loss."""
    rows = [(0.0, 0.0)] * 6 + [(1.0, 0.0)] * 2 + [(1.0, 1.0)] * 6 + [(0.0, 1.0)] * 2
    frame = spark.createDataFrame(rows, "label double, x double")
    frame = ColumnEncoder("passthrough", "ordinal").fit(frame).transform(frame)
    model = SoftmaxBoosting(rounds=1, depth=1, eta=0.3, lam=1.0, min_child_weight=0.0).fit(frame)
    got = {r["label"]: r for r in model.margins(frame).filter(vector_to_array("features")[0] == 0).collect()}
    g, h = 8 * 0.5 - 6, 8 * 0.5
    assert got[0.0]["margin"][0] == pytest.approx(-0.3 * g / (h + 1.0))
    assert got[0.0]["margin"][1] == pytest.approx(0.3 * g / (h + 1.0))


def test_shapley_adds_up(spark, split):
    train, held = split
    forest = Forest(trees=3, max_depth=4).fit(train)
    sample = held.select("incident_id", vector_to_array("features").alias("x")).limit(40)
    sample = cut_lineage(sample)

    def scorer(df):
        return forest.transform(df)

    phi = attribution.sampled_shapley(sample, "incident_id", scorer, 6, len(CLASSES), permutations=3)
    assert phi.count() == 40 * 6 * len(CLASSES)
    assert phi.groupBy("incident_id", "class_id").agg(F.sum("phi").alias("s")).agg(F.max(F.abs("s"))).first()[0] <= 1.0
    ranked = attribution.global_importance(phi).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 7))
    assert ranked[0]["feature"] in ("f0", "f1")
    with pytest.raises(ValueError):
        attribution.class_id_of("nowhere", CLASSES)


def test_transforms_learn_from_training_rows_only(spark, small):
    rows = small_rows(spark, small)
    stages = [GeoEncoder("all", 4), ColumnEncoder("robust", "frequency", skip=("incident_id", "target", "incident_timestamp"))]
    model = Pipeline(stages=stages).fit(rows.filter(EARLY))
    late = rows.filter(~F.expr(EARLY))
    alone = {r["incident_id"]: r["features"] for r in model.transform(late.filter("incident_id % 2 = 0")).collect()}
    together = {r["incident_id"]: r["features"] for r in model.transform(late.unionByName(rows)).collect()}
    assert alone and all(together[k] == v for k, v in alone.items())


def test_saved_pipeline(spark, small, tmp_path):
    rows = small_rows(spark, small)
    keep = ("incident_id", "target", "incident_timestamp")
    for kind, numeric in (("onehot", "standard"), ("ordinal", "binned")):
        stages = [GeoEncoder("raw_cluster", 4), ColumnEncoder(numeric, kind, skip=keep)]
        model = Pipeline(stages=stages).fit(rows)
        path = str(tmp_path / kind)
        model.write().overwrite().save(path)
        a = {r["incident_id"]: r["features"] for r in model.transform(rows).collect()}
        b = {r["incident_id"]: r["features"] for r in PipelineModel.load(path).transform(rows).collect()}
        assert a == b


def test_runs_and_masters(spark, small, tmp_path):
    folder = str(tmp_path / "results")
    data = modeling(spark, small)
    configs = [
        config.dummy_baseline(),
        config.logistic_baseline().but(experiment_name="few_steps", logistic_max_iter=3, add_address_engineering=False),
    ]
    folds, summary = experiments.run_suite(configs, data, (1998,), folder, test_start=fixtures.TEST_START)
    by_name = {r["experiment_name"]: r for r in folds.collect()}
    assert by_name["few_steps"]["model_iterations"] <= 3 and by_name["dummy_class_prior"]["model_iterations"] is None
    assert by_name["few_steps"]["log_loss"] != by_name["dummy_class_prior"]["log_loss"]
    assert summary.count() == 2
    master, sums = results.rebuild_master(spark, folder)
    assert master.columns[0] == "run_id" and master.count() == 2 and sums.count() == 2
    assert spark.read.option("header", True).csv(f"{folder}/dashboard/experiment_fold_results").count() == 2


def test_final_model(spark, small, tmp_path):
    data = modeling(spark, small)
    chosen = config.dummy_baseline()
    final = finals.train_final(chosen, data, {"frozen_test_accuracy": 0.5})
    path = str(tmp_path / "final")
    final.save(path)
    loaded = finals.FinalModel.load(path)
    assert loaded.metadata["class_count"] == 7 and loaded.metadata["frozen_test_accuracy"] == 0.5
    best = loaded.top_categories(data, k=3).collect()
    assert len(best) == 3 * data.count()
    found = finals.evaluate_frozen(chosen, data, fixtures.TEST_START)
    tables = found.tables()
    assert tables["calibration_bins"].count() == 10 and tables["per_class_metrics"].count() == 7
    places = found.export(str(tmp_path / "report"))
    assert len(places) == 9
    for name, place in places.items():
        assert spark.read.option("header", True).csv(place).count() == tables[name].count(), name


def test_explanation(spark, small, tmp_path):
    """One plan: names instead of slots, trees' importances, and attributions that add up between prediction and background."""
    data = modeling(spark, small)
    chosen = config.random_forest_baseline().but(experiment_name="explained", geo_mode="raw", forest_n_estimators=3, forest_max_depth=4, add_cyclical=False)
    found = explanation.explain(chosen, data, size=60, permutations=3)
    tables = found.tables()
    names = {r["feature"] for r in tables["shap_global_importance"].collect()}
    assert names == set(found.names) and {"incident_hour", "pd_district"} < names
    importance = {r["feature"]: r for r in tables["tree_importance"].collect()}
    assert set(importance) <= names and all(r["weight"] > 0 and r["cover"] > 0 for r in importance.values())
    assert tables["top_gain"].count() == min(20, len(importance))
    sums = found.attributions.groupBy("incident_id").agg(F.sum("phi").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert sums < 1e-9  # probabilities of all classes add up to one on both sides
    assert found.of_class("C2").select("class_id").distinct().first()[0] == 2
    assert len(found.export(str(tmp_path / "explained"))) == 5
    with pytest.raises(ValueError, match="no encoded features"):
        explanation.explain(config.dummy_baseline(), data)
