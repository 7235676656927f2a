"""The spread of contributions: one reading of its input, whatever the number of passes."""

import statistics

import pytest
from pyspark.sql import functions as F

from blotter.operators import attribution
from blotter.operators.quantiles import grouped_quantiles


def test_contributions_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    values = [(f"f{i % 2}", (i * 37 % 101 - 50) / 100 if i % 13 else None) for i in range(1300)]
    rows = spark.createDataFrame(values, "feature string, phi double").mapInArrow(count, "feature string, phi double")
    found = {r["feature"]: r for r in attribution.distribution(rows).collect()}
    assert read.value == 1300
    for feature in ("f0", "f1"):
        known = [v for f, v in values if f == feature and v is not None]
        row = found[feature]
        assert (row["rows"], row["low"], row["high"]) == (650, min(known), max(known))
        assert row["mean_abs"] == pytest.approx(statistics.fmean(map(abs, known)))
        assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(statistics.quantiles(known, n=4, method="inclusive"))


def test_weighted_quantiles_equal_those_of_repeated_rows(spark):
    counted = spark.createDataFrame([("a", float(i * i % 17), i % 4) for i in range(1, 60)] + [("b", 1.5, 3), ("c", None, 2)], "g string, v double, n int")
    repeated = counted.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    probs = (0.0, 0.3, 0.5, 0.9, 1.0)
    assert grouped_quantiles(counted.filter("n > 0"), "g", "v", probs, weight="n") == grouped_quantiles(repeated, "g", "v", probs)
