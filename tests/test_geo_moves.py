"""k-means moves the centers of all starts by few jobs, to where the library moves each."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from blotter.operators import geo

FILL = {"longitude": 0.0, "latitude": 0.0}


@pytest.mark.parametrize("points", [50_000, 500])
def test_centers_equal_the_library(spark, monkeypatch, points):
    monkeypatch.setattr(geo, "TASK_POINTS", points)
    k = F.col("id")
    rows = spark.range(4000).select((k * 37 % 140 / 100).alias("longitude"), (k * 53 % 120 / 100).alias("latitude"))
    asked = []
    plain = KMeans.fit
    with monkeypatch.context() as m:
        m.setattr(KMeans, "fit", lambda self, data: asked.append(self.getMaxIter()) or plain(self, data))
        found = geo.fit_centers(rows, "longitude", "latitude", FILL, 7, n_init=4)
    # The library draws the first centers and moves none: its jobs don't grow with the moves.
    assert asked == [0] * 4
    counted = rows.groupBy(F.col("longitude").alias("x"), F.col("latitude").alias("y")).agg(F.count("*").cast("double").alias("w"))
    dealt = counted.repartition(counted.count() // points + 1, "x", "y").sortWithinPartitions("x", "y").persist()
    data = VectorAssembler(inputCols=["x", "y"], outputCol="point").transform(dealt).select("point", "w")
    fits = [KMeans(featuresCol="point", weightCol="w", k=7, seed=12345 + s, maxIter=100).fit(data) for s in range(4)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    assert np.allclose(found, sorted(tuple(c) for c in best.clusterCenters()), atol=1e-9)
    dealt.unpersist()
