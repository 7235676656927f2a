"""The ways taken for large or skewed data give the same results as the simple ones."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from blotter.operators import attribution, levels, lookup, quantiles, splits
from blotter.operators.levels import fit_levels, level_sizes, count_levels, with_codes
from blotter.operators.quantiles import grouped_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are null, some unseen in training."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else (None if i % 101 == 0 else f"k{rng.randrange(900)}")
        rows.append((i, key, rng.gauss(0, 1) if i % 17 else None, float(rng.randrange(6))))
    return spark.createDataFrame(rows, "id bigint, key string, x double, n double").persist()


@pytest.mark.parametrize("null_level", [True, False])
def test_lookup_without_broadcast(spark, skewed, null_level):
    train = skewed.filter("id < 4000")
    table = fit_levels(train, ["key"], fill=None if null_level else "UNKNOWN")
    key = F.col("key") if null_level else F.coalesce("key", F.lit("UNKNOWN"))
    small, large = (
        {r["id"]: r["v"] for r in lookup.attach(skewed, key, table.of("key"), "code", "v", -1, flag).collect()}
        for flag in (True, False)
    )
    assert len(small) == 6000 and small == large
    assert -1 in small.values()


def test_large_lookup_spreads_the_hot_key(spark, skewed):
    table = fit_levels(skewed, ["key"])
    plan = lookup.attach(skewed, F.col("key"), table.of("key"), "code", "v", -1, False)
    assert "GlobalLimit 5000" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_inlined_levels(spark, skewed):
    few = skewed.withColumn("c", F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 7)))
    table = fit_levels(few.filter("id % 7 < 5"), ["c"], fill=None)
    known = table.inline()["c"]
    names, codes = [k for k, _, _ in known], [c for _, c, _ in known]
    a = few.select("id", lookup.inlined(F.col("c"), names, codes, -1).alias("v"))
    b = lookup.attach(few, F.col("c"), table.of("c"), "code", "v", -1, True).select("id", "v")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_codes_of_many_levels(spark, skewed):
    both = skewed.withColumn("other", F.concat(F.lit("o"), F.col("id") % 37))
    counts = count_levels(both, ["key", "other"])
    sizes = level_sizes(counts)
    one_task = {(r["feature"], r["level"]): r["code"] for r in with_codes(counts, sizes).collect()}
    spread = {(r["feature"], r["level"]): r["code"] for r in with_codes(counts, sizes, per_task=10).collect()}
    assert one_task == spread and len(spread) == sum(n for n, _ in sizes.values())


def test_shares_of_many_levels(spark, skewed):
    a = {r["level"]: r["share"] for r in fit_levels(skewed, ["key"]).table.collect()}
    b = {r["level"]: r["share"] for r in fit_levels(skewed, ["key"], per_task=10).table.collect()}
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1)


@pytest.mark.parametrize("few", [0, 10**6])
@pytest.mark.parametrize("method", ["linear", "averaged_inverted_cdf"])
def test_quantiles(spark, skewed, few, method):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(skewed, ["x", "n"], probs, method, few)
    frame = skewed.toPandas()
    for c in ("x", "n"):
        assert got[c] == pytest.approx(np.quantile(frame[c].dropna(), probs, method=method), abs=1e-12)


def test_quantiles_of_filled_column(spark, skewed):
    probs = [i / 10 for i in range(11)]
    stats = quantiles.profile(skewed, ["x", "n"])
    for method in ("linear", "averaged_inverted_cdf"):
        got = quantiles.imputed_quantiles(skewed, stats, probs, method)
        frame = skewed.toPandas()
        for c in ("x", "n"):
            filled = frame[c].fillna(frame[c].median())
            assert got[c][0] == pytest.approx(frame[c].median())
            assert got[c][1] == pytest.approx(np.quantile(filled, probs, method=method), abs=1e-12)


@pytest.mark.parametrize("slices", [2, 64, 4096])
def test_random_split(spark, skewed, slices):
    rows = skewed.select("id", F.coalesce("key", F.lit("none")).alias("target"))
    split = splits.random_split(rows, "id", slices=slices).collect()
    assert len(split) == 6000
    sizes, tests = {}, {}
    for r in split:
        sizes[r["target"]] = sizes.get(r["target"], 0) + 1
        tests[r["target"]] = tests.get(r["target"], 0) + r["is_test"]
    assert tests == {k: int(n * 0.4 + 0.5) for k, n in sizes.items()}
    again = {r["id"]: r["is_test"] for r in splits.random_split(rows, "id").collect()}
    assert again == {r["id"]: r["is_test"] for r in split}


def test_hot_keys_of_the_scored_rows(spark):
    """60 % of the scored rows have a level that training never saw, 20 % one that was rare there: none meets in one task."""
    n = 40_000
    k = F.when(F.col("id") % 10 < 6, "unseen").when(F.col("id") % 10 < 8, "rare").otherwise(F.concat(F.lit("l"), (F.col("id") % 9000).cast("string")))
    scored = spark.range(0, n, 1, 8).select("id", k.alias("k"))
    levels = spark.range(9000).select(F.concat(F.lit("l"), "id").alias("level"), F.col("id").cast("int").alias("v"))
    levels = levels.unionByName(spark.createDataFrame([("rare", -7)], "level string, v int"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, value in zip(old, ("false", "16", "-1")):
            spark.conf.set(c, value)
        found = lookup.attach(scored, F.col("k"), levels, "v", "found", -1, False).withColumn("task", F.spark_partition_id())
        rows = found.collect()
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    want = lambda r: -1 if r["k"] == "unseen" else -7 if r["k"] == "rare" else int(r["k"][1:])
    assert len(rows) == n and all(r["found"] == want(r) for r in rows)
    tasks = Counter(r["task"] for r in rows)
    assert len(tasks) == 16 and max(tasks.values()) < 2 * n / 16


@pytest.mark.parametrize("kind", ["continuous", "ties", "wide"])
def test_quantiles_by_group(spark, kind):
    draw = random.Random(4)
    make = {"continuous": lambda: draw.gauss(0, 1), "ties": lambda: float(draw.randrange(4)), "wide": lambda: draw.choice([-1.7e308, 1.7e308, 0.0, 1e-300, 5.0, float("nan")])}[kind]
    values = {g: [make() for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 777), (None, 40))}
    rows = [(g, v) for g, own in values.items() for v in own] + [("none", None)]
    got = grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.0, 0.25, 0.5, 0.9, 1.0])
    for g, own in values.items():
        known = sorted(v for v in own if v == v)
        if not known:
            assert g not in got
            continue
        for p, q in zip([0.0, 0.25, 0.5, 0.9, 1.0], got[g]):
            place = (len(known) - 1) * p
            low, high = known[int(place)], known[min(int(place) + 1, len(known) - 1)]
            assert q == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12)
    assert "none" not in got
    with pytest.raises(ValueError, match="infinite"):
        grouped_quantiles(spark.createDataFrame([("a", float("inf")), ("a", 1.0)], "g string, v double"), "g", "v", [0.5])


def test_names_of_sampled_values(spark):
    sample = spark.range(30).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    score = lambda df: df.withColumn("probability", F.array(vector_to_array("features")[0])).drop("features")
    phi = attribution.sampled_shapley(sample, "id", score, 2, 1, permutations=2, names=["first", "second"])
    assert {r["feature"] for r in phi.collect()} == {"first", "second"}
    with pytest.raises(ValueError, match="names"):
        attribution.sampled_shapley(sample, "id", score, 2, 1, names=["first"])
    with pytest.raises(ValueError, match="sample"):
        attribution.sampled_shapley(sample, "id", score, 2, 1, limit=10)
