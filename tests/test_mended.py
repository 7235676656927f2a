"""Limits that must raise or be exact, missing numbers, names of slots, and plans over the stored table."""

import math

import pytest
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import functions as F

from blotter.models.boosting import SoftmaxBoosting
from blotter.operators import attribution, lookup, splits
from blotter.operators.encoding import ColumnEncoder
from blotter.operators.geo import N_INIT, GeoEncoder
from blotter.operators.quantiles import exact_quantiles, medians
from blotter.plans import assemble, config
from blotter.sources import incidents


def two_classes(spark, rows=180):
    data = [(float(i % 2), Vectors.dense([float(i % 2), float(i % 7)])) for i in range(rows)]
    return spark.createDataFrame(data, ["label", "features"])


@pytest.mark.parametrize(("weight", "nodes"), [(1.0, 3), (1e6, 1)])
def test_child_weight_beyond_half_gives_one_leaf(spark, weight, nodes):
    model = SoftmaxBoosting(rounds=1, depth=1, min_child_weight=weight).fit(two_classes(spark))
    assert {r["count"] for r in model.nodes(spark).groupBy("round", "class").count().collect()} == {nodes}


def test_starts_of_k_means():
    assert GeoEncoder("cluster").n_init == N_INIT == 10
    assert assemble.tree_transform()[0].n_init == 10 and assemble.tree_transform(n_init=2)[0].n_init == 2


@pytest.mark.parametrize("few", [10, 0])
def test_nan_is_missing(spark, few):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, float("nan"), None)], "v double")
    assert exact_quantiles(df, ["v"], [0.5], few_values=few) == {"v": [2.5]}
    model = ColumnEncoder("standard", "ordinal", skip=(), output="columns").fit(df)
    values = [r["v"] for r in model.transform(df).collect()]
    assert all(math.isfinite(v) for v in values) and values[4] == values[5]
    assert abs(sum(values)) < 1e-9


def test_wide_and_infinite_ranges_end(spark):
    wide = spark.createDataFrame([(x,) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, 3.0)], "v double")
    assert exact_quantiles(wide, ["v"], [0.0, 1.0], few_values=0) == {"v": [-1.7e308, 1.7e308]}
    assert medians(wide, ["v"])["v"] == 5e-301
    with pytest.raises(ValueError, match="infinite"):
        medians(spark.createDataFrame([(float("inf"),), (1.0,)], "v double"), ["v"])


def test_nan_coordinates(spark):
    rows = [(-122.4 + i % 3 / 10, 37.7 + i % 2 / 10) for i in range(30)] + [(float("nan"), 37.7), (None, float("nan"))]
    df = spark.createDataFrame(rows, "longitude double, latitude double")
    model = GeoEncoder("all", n_clusters=3, n_init=2).fit(df)
    out = model.transform(df).select("geo_distance_0", "geo_cluster").collect()
    assert all(math.isfinite(r["geo_distance_0"]) and r["geo_cluster"] for r in out)


def test_slot_names_of_one_hot(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (2.0, "b", "x"), (3.0, "a", None)], "n double, c string, d string")
    model = ColumnEncoder("standard", "onehot", skip=()).fit(df)
    names = model.slot_names()
    assert len(names) == model.width() and names[0] == "n" and {"c=a", "c=b", "d=x"} < set(names)
    assert model.slots().count() == len(names)
    vector = model.transform(df.filter("n = 2")).first()["features"]
    assert {names[i] for i in vector.toArray().nonzero()[0]} >= {"c=b", "d=x"}


def test_sparse_false_gives_dense(spark):
    df = spark.createDataFrame([(float(i), f"c{i % 9}") for i in range(20)], "n double, c string")
    assert isinstance(ColumnEncoder("standard", "onehot", skip=(), sparse=False).fit(df).transform(df).first()["features"], DenseVector)


def test_iterations_of_models_without_solver(spark):
    class Fitted:
        stages = [object()]

    assert assemble.iterations(Fitted()) is None
    Fitted.stages[0] = SoftmaxBoosting(rounds=2, depth=1).fit(two_classes(spark))
    assert assemble.iterations(Fitted(), "xgboost") is None and assemble.iterations(Fitted(), "hist_gradient_boosting") == 2


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    want = {r["k"] for r in df.withColumn("h", splits.row_hash("k", 12345)).orderBy("h", "k").limit(50).collect()}
    assert {r["k"] for r in attribution.reproducible_sample(df, "k", 50).collect()} == want
    assert attribution.reproducible_sample(df.limit(30), "k", 50).count() == 30


def test_served_rows_spread_without_bound(spark):
    """Rows of a hot level keep no common join key."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("l"), "id")).alias("k"))
    levels = df.groupBy(F.col("k").alias("level")).agg((F.count("*") / 5000).alias("share")).withColumn("v", F.length("level"))
    levels = levels.withColumn("share", F.when(F.col("level") == "hot", F.col("share")).otherwise(0.0))
    out = lookup.attach(df, F.col("k"), levels, "v", "found", -1, small=False)
    assert out.filter(F.col("found") != F.length("k")).count() == 0 and out.count() == 5000


def test_stored_rows_have_keys_and_prune(spark, tmp_path):
    """From the file to a split, a sample and a year's partitions."""
    lines = ["Dates,Category,Descript,DayOfWeek,PdDistrict,Resolution,Address,X,Y"]
    for i in range(120):
        lines.append(f"20{11 + i % 3}-05-13 {i % 24:02d}:53:00,C{i % 4},d,Wednesday,D{i % 3},NONE,OAK ST / LAGUNA ST,-122.4,37.7")
    lines += lines[-1:] * 5
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    incidents.store_raw(incidents.scan_csv(spark, str(tmp_path / "in.csv")), str(tmp_path / "raw"))
    data = incidents.modeling_frame(incidents.read_raw(spark, str(tmp_path / "raw")))
    assert data.select("incident_id").distinct().count() == 125
    assert splits.random_split(data, "incident_id").filter("is_test").count() in range(45, 56)
    assert attribution.reproducible_sample(data, "incident_id", 10).count() == 10
    fold = data.filter(splits.in_period(start="2012-01-01", end="2013-01-01", year_column="incident_year"))
    plan = fold._jdf.queryExecution().executedPlan().toString()
    assert "incident_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in fold.select("incident_year").distinct().collect()} == {2012} and fold.count() > 0
