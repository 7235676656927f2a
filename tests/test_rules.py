"""Edge rows and the errors that must be raised."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter.functions import address, calendar, probability as prob
from blotter.models.mllib import MultinomialLogistic
from blotter.models.prior import ClassPrior
from blotter.operators import encoding, features, metrics, splits
from blotter.operators.geo import GeoEncoder
from blotter.plans import assemble, config
from blotter.sources import incidents, results


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, mode, expected",
    [
        ("OAK ST/LAGUNA  ST", "intended", "OAK ST / LAGUNA  ST"),
        ("OAK ST/LAGUNA  ST", "observed", "OAK ST/LAGUNA  ST"),
        (" A  /B ", "intended", "A / B"),
    ],
)
def test_normalise(spark, text, mode, expected):
    assert one(spark, address.normalise(F.col("a"), mode), a=text) == expected


def test_streets(spark):
    assert one(spark, address.first_street(F.col("a")), a="800 block OF BRYANT ST") == "BRYANT ST"
    assert one(spark, address.first_street(F.col("a"), "observed"), a="800 Block of BRYANT ST") == "800 Block of BRYANT ST"
    assert one(spark, address.second_street(F.col("a")), a="A/B") is None
    assert one(spark, address.second_street(F.col("a")), a="A / B") == "B"
    assert one(spark, address.block_number(F.col("a")), a="99999999999 Block of X") is None
    assert one(spark, address.block_number(F.col("a")), a="no number") is None
    with pytest.raises(ValueError):
        address.normalise(F.col("a"), "other")


def test_calendar(spark):
    ts = F.lit("2024-12-30 23:59:58.25").cast("timestamp_ntz")
    got = spark.range(1).select(
        F.weekofyear(ts).alias("w"), calendar.day_of_week(ts).alias("d"), calendar.epoch_seconds(ts).alias("e")
    ).first()
    assert (got["w"], got["d"]) == (1, 1)
    assert got["e"] == (datetime(2024, 12, 30, 23, 59, 58) - datetime(1970, 1, 1)).total_seconds() + 0.25


def test_malformed_lines_are_skipped(spark, tmp_path):
    good = "2011-01-01 00:01:00,A,d,Monday,P,NONE,1 Block of X,-122.4,37.7"
    lines = ["Dates,Category,Descript,DayOfWeek,PdDistrict,Resolution,Address,X,Y", good]
    lines += [good + ",extra", good.replace("-122.4", "west"), good]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    frame = incidents.scan_csv(spark, str(tmp_path / "in.csv"))
    assert frame.count() == 2
    assert frame.select("Category").count() == 2
    assert frame.select("X").collect()[0]["X"] == -122.4


def test_missing_columns(spark):
    frame = spark.createDataFrame([(1,)], ["incident_year"])
    with pytest.raises(KeyError, match="pd_district"):
        features.base_frame(frame)
    with pytest.raises(KeyError):
        incidents.split_target(frame)
    with pytest.raises(ValueError):
        features.cyclical(frame, {"incident_year": 0})


def test_cycle_of_text(spark):
    frame = spark.createDataFrame([("6",), ("x",)], ["incident_hour"])
    rows = features.cyclical(frame, {"incident_hour": 24}).collect()
    assert rows[0]["incident_hour_sin"] == pytest.approx(1.0)
    assert rows[1]["incident_hour_sin"] is None


def test_interactions_before_dropping(spark, small):
    from workload.base import modeling

    frame = features.feature_frame(modeling(spark, small), drop_original_cyclical=True)
    assert "district_hour" in frame.columns and "incident_hour" not in frame.columns
    assert len(features.feature_frame(modeling(spark, small)).columns) == 30


def predictions(spark, rows):
    return spark.createDataFrame(rows, "label int, probability array<double>")


def test_ties(spark):
    rows = predictions(spark, [(0, [0.25, 0.25, 0.25, 0.25]), (3, [0.25, 0.25, 0.25, 0.25])])
    got = rows.select(prob.predicted().alias("p"), prob.in_top_k(4).alias("t")).collect()
    assert [r["p"] for r in got] == [0, 0]
    assert [r["t"] for r in got] == [0, 1]


@pytest.mark.parametrize("n", [3, 70])
def test_long_arrays_use_the_same_rules(spark, n):
    weights = [float((i * 7) % 5 + 1) for i in range(n)]
    p = [w / sum(weights) for w in weights]
    rows = predictions(spark, [(2, p)])
    got = rows.select(prob.in_top_k(n).alias("t"), prob.brier(n).alias("b"), prob.neg_log().alias("l")).first()
    place = sorted(range(n), key=lambda i: (p[i], i), reverse=True).index(2)
    assert got["t"] == int(place < 3)
    assert got["b"] == pytest.approx(sum((x - (i == 2)) ** 2 for i, x in enumerate(p)))
    even = prob.normalise(predictions(spark, [(0, [2.0] * n)]), n).first()["probability"]
    assert even == pytest.approx([1 / n] * n)


def test_zero_rows(spark):
    rows = predictions(spark, [(0, [0.0, 0.0])])
    assert prob.align(rows, ["a", "b"], ["a", "b"], "uniform").first()["probability"] == [0.5, 0.5]
    with pytest.raises(Exception, match="zero total probability"):
        prob.align(rows, ["a", "b"], ["a", "b"]).collect()
    with pytest.raises(KeyError):
        prob.align(rows, ["a", "z"], ["a", "b"])


def test_calibration_borders(spark):
    rows = spark.createDataFrame([(c,) for c in (0.0, 0.1, 0.3, 0.30000000000000004, 1.0)], "confidence double")
    bins = [r[0] for r in rows.select(metrics.calibration_bin(10)).collect()]
    assert bins == [0, 0, 2, 2, 9]
    values = [0.0, 0.05, 0.15, 0.3, 0.35, 0.95, 1.0]
    made = predictions(spark, [(0, [v]) for v in values])
    counts = {r["slot"]: r["n"] for r in metrics.confidence_histogram(made).collect()}
    expected, _ = np.histogram(values, np.linspace(0, 1, 21))
    assert [counts[i] for i in range(20)] == expected.tolist()


def test_empty_bins_and_sums(spark):
    rows = predictions(spark, [(0, [0.7, 0.3]), (1, [0.6, 0.4]), (1, [0.1, 0.9])])
    table = metrics.calibration_table(rows, 2).orderBy("bin").collect()
    assert len(table) == 10 and sum(r["row_count"] for r in table) == 3
    assert table[0]["mean_confidence"] is None and table[0]["calibration_gap"] is None


def test_zero_support_classes(spark):
    # Class 2 is predicted but never true, class 3 neither.
    rows = predictions(spark, [(0, [0.7, 0.1, 0.2, 0.0]), (1, [0.1, 0.2, 0.7, 0.0])])
    assert metrics.macro_f1(rows, 4).first()[0] == pytest.approx((1 + 0 + 0) / 3)
    table = {r["crime_category"]: r for r in metrics.per_class(rows, list("abcd")).collect()}
    assert len(table) == 4 and table["d"]["support"] == 0 and table["c"]["precision"] == 0
    assert table["a"]["f1_rank"] == 1 and table["b"]["f1_rank"] == table["d"]["f1_rank"] == 2
    cells = metrics.confusion(rows, 4).collect()
    sums = {}
    for c in cells:
        sums[c["label"]] = sums.get(c["label"], 0) + c["share"]
    assert len(cells) == 16 and sums[0] == sums[1] == 1 and sums[2] == sums[3] == 0


def events(spark, dates):
    return spark.createDataFrame([(d, "a") for d in dates], "d string, target string").select(
        F.col("d").cast("timestamp_ntz").alias("incident_timestamp"), "target"
    )


def test_empty_periods(spark):
    frame = events(spark, ["2010-01-01", "2011-06-01"])
    with pytest.raises(ValueError):
        splits.frozen_test(frame, "2014-01-01")
    with pytest.raises(ValueError):
        splits.frozen_test(frame, "2009-01-01")
    with pytest.raises(ValueError, match="no validation"):
        splits.fold_facts(frame, splits.calendar_folds((2012,)))
    with pytest.raises(ValueError, match="no train"):
        splits.fold_facts(frame, splits.calendar_folds((2010,)))
    facts = splits.fold_facts(frame, splits.calendar_folds((2011,)))
    assert facts.records[0]["train_rows"] == facts.records[0]["validation_rows"] == 1


def test_folds_are_disjoint_and_ordered(spark, small):
    from workload.base import development

    for fold in splits.calendar_folds((1998, 1999, 2000)):
        data = development(spark, small)
        last = fold.train(data).agg(F.max("incident_timestamp")).first()[0]
        first = fold.validation(data).agg(F.min("incident_timestamp")).first()[0]
        assert last < first


def test_year_predicate_reaches_the_partitions(spark, small, tmp_path):
    from workload.base import raw

    path = str(tmp_path / "raw")
    incidents.store_raw(raw(spark, small), path)
    stored = incidents.read_raw(spark, path).withColumn("ts", F.col("Dates").try_cast("timestamp_ntz"))
    late = stored.filter(splits.in_period("ts", "2000-01-01", year_column="incident_year"))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(incident_year" in plan
    assert late.count() == stored.filter("ts >= timestamp_ntz'2000-01-01'").count()


def test_one_class(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], ["label", "x"])
    assert ClassPrior().fit(frame).transform(frame).first()["probability"] == [1.0]
    with pytest.raises(ValueError, match="two classes"):
        MultinomialLogistic().fit(frame)


def test_unseen_and_missing_levels(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    later = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    for kind, wanted in (("ordinal", [1, -1, 0]), ("frequency", [1 / 3, 0.0, 1 / 3])):
        model = encoding.ColumnEncoder("passthrough", kind, output="columns").fit(train)
        assert [r["c"] for r in model.transform(later).collect()] == pytest.approx(wanted)
    model = encoding.ColumnEncoder("passthrough", "ordinal", output="columns", shift=1).fit(train)
    assert [r["c"] for r in model.transform(later).collect()] == [2, 0, 1]
    model = encoding.ColumnEncoder("passthrough", "onehot").fit(train)
    vectors = [r["features"].toArray().tolist() for r in model.transform(later).collect()]
    assert vectors == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]
    with pytest.raises(ValueError, match="missing"):
        model.transform(later.withColumnRenamed("c", "other")).collect()


def test_column_without_values_is_left_out(spark):
    frame = spark.createDataFrame([(1.0, None, True), (3.0, None, False)], "x double, y double, z boolean")
    model = encoding.ColumnEncoder("standard", "onehot", output="columns").fit(frame)
    assert model.encoded_columns == ["x", "z"]
    assert "y" not in model.transform(frame).columns


def test_geo_rules(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], ["longitude", "latitude"])
    with pytest.raises(ValueError):
        GeoEncoder("elsewhere").fit(frame)
    with pytest.raises(ValueError):
        GeoEncoder("raw", n_clusters=1).fit(frame)
    with pytest.raises(KeyError):
        GeoEncoder("raw").fit(frame.drop("latitude"))


@pytest.mark.parametrize(
    "change",
    [
        dict(experiment_name=" "),
        dict(n_geo_clusters=1),
        dict(numeric_bins=1),
        dict(model_name="naive_bayes"),
        dict(model_name="hist_gradient_boosting"),
        dict(logistic_c=0.0),
        dict(logistic_max_iter=0),
        dict(logistic_tol=0.0),
        dict(logistic_l1_ratio=1.5),
        dict(logistic_class_weight="heavy"),
        dict(logistic_l1_ratio=0.1, logistic_solver="lbfgs"),
        dict(forest_n_estimators=0),
        dict(forest_max_depth=0),
        dict(forest_min_samples_split=1),
        dict(forest_min_samples_leaf=0),
        dict(forest_criterion="other"),
        dict(forest_class_weight="other"),
        dict(xgb_gamma=-0.1),
        dict(xgb_reg_alpha=-0.1),
        dict(xgb_reg_lambda=-0.1),
    ],
)
def test_config_rules(change):
    with pytest.raises(ValueError):
        config.logistic_baseline().but(**change).validate()


def test_presets():
    assert len(config.CONFIG_FIELDS) == 39
    for preset in config.PRESETS.values():
        preset().validate()
        assert assemble.model_stage(preset()) is not None
    with pytest.raises(ValueError):
        assemble.model_stage(config.logistic_baseline().but(model_name="other"))
    assert config.xgboost_finalist().xgb_n_estimators == 600


def test_run_ids_differ():
    when = datetime(2026, 7, 14, 20, 36, 21)
    first, second = (results.new_run_id(config.dummy_baseline(), when) for _ in range(2))
    assert first.startswith("dummy_class_prior__20260714T203621Z") and first != second
