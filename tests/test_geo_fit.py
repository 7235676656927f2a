"""k-means over counted coordinates: its tasks go by the coordinates, not by the session's shuffle partitions."""

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from blotter.operators import geo

FILL = {"longitude": 0.0, "latitude": 0.0}


@pytest.fixture
def coordinates(spark):
    k = F.col("id")
    return spark.range(3000).select((k * 37 % 140).cast("double").alias("longitude"), F.when(k % 101 > 0, (k * 53 % 120).cast("double")).alias("latitude"))


@pytest.mark.parametrize(("points", "tasks"), [(50_000, 1), (300, 3)])
def test_tasks_follow_the_coordinates(spark, coordinates, monkeypatch, points, tasks):
    monkeypatch.setattr(geo, "TASK_POINTS", points)
    met, plain = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: met.append((data.rdd.getNumPartitions(), data.agg(F.sum("w")).first()[0])) or plain(self, data))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (4, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            found.append(geo.fit_centers(coordinates, "longitude", "latitude", FILL, 6, n_init=2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    distinct = coordinates.fillna(FILL).distinct().count()
    assert 840 <= distinct < 900 and {m for m in met} == {(tasks, 3000.0)}
    assert found[0] == found[1] and len(found[0]) == 6
