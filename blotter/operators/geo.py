"""Geographic clusters and center distances learned from the training rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blotter.functions.probability import number
from blotter.operators.quantiles import medians
from blotter.schema import require_columns
from blotter.session import cached

CLUSTER_MODES = ("cluster", "raw_cluster", "all")
DISTANCE_MODES = ("distances", "raw_distances", "all")
RAW_MODES = ("raw", "raw_cluster", "raw_distances", "all")
N_INIT = 10  # k-means starts, the best is kept
TASK_POINTS = 50_000  # distinct coordinates that a task of k-means takes
TOLERANCE = 1e-4  # centers that move no further have settled
AT_ONCE = 4096  # points whose distances a task holds at a time
MODES = ("raw", "cluster", "distances", "raw_cluster", "raw_distances", "all", "none")


def fit_centers(
    df: DataFrame,
    lon: str,
    lat: str,
    fill: dict[str, float],
    k: int,
    seed: int = 12345,
    n_init: int = N_INIT,
    max_iter: int = 100,
) -> list[tuple[float, float]]:
    """Weighted k-means over distinct coordinates, the best of ``n_init`` starts.

    Incidents share few coordinates (addresses are rounded to blocks), so rows
    are first counted per coordinate: the objective stays the same while every
    iteration reads far fewer rows. Centers are sorted to give stable numbers.

    Tasks go by the number of coordinates, not by the session's shuffle
    partitions; their order is fixed, as the draws of a start follow it. Only
    the first centers are drawn start by start: then one job moves the centers
    of all starts once, or, where one task holds all coordinates, to the end.
    """
    points = df.groupBy(
        F.coalesce(_number(lon), F.lit(fill[lon])).alias("x"),
        F.coalesce(_number(lat), F.lit(fill[lat])).alias("y"),
    ).agg(F.count("*").cast("double").alias("w"))
    with cached(points) as points:
        tasks = points.count() // TASK_POINTS + 1
        dealt = points.repartition(tasks, "x", "y").sortWithinPartitions("x", "y").persist()
        dealt.count()
    try:
        # Not persisted itself: then each fit keeps its vectors as objects while it iterates.
        data = VectorAssembler(inputCols=["x", "y"], outputCol="point").transform(dealt).select("point", "w")

        def drawn(start: int) -> np.ndarray:
            model = KMeans(featuresCol="point", weightCol="w", k=k, seed=seed + start, maxIter=0, initMode="k-means||").fit(data)
            return np.array(model.clusterCenters())

        # Starts are independent; their small jobs share the cluster.
        with ThreadPoolExecutor(min(n_init, 5)) as pool:
            first = list(pool.map(inheritable_thread_target(df.sparkSession)(drawn), range(n_init)))
        moved = _moved_at_once(dealt, first, max_iter) if tasks == 1 else _moved_in_turn(dealt, first, max_iter)
    finally:
        dealt.unpersist()
    _, _, best = min((cost, start, centers.tolist()) for start, (cost, centers) in enumerate(moved))
    return sorted((c[0], c[1]) for c in best)


def _step(x: np.ndarray, y: np.ndarray, w: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Weight and weighted coordinates of each center's points, and their cost; ties go to the first center."""
    near, cost = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        squared = (x[part, None] - centers[:, 0]) ** 2 + (y[part, None] - centers[:, 1]) ** 2
        near[part] = squared.argmin(axis=1)
        cost[part] = squared.min(axis=1) * w[part]
    return np.stack([np.bincount(near, weights=v, minlength=len(centers)) for v in (w, w * x, w * y, cost)])


def _update(centers: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, bool]:
    """The centers moved, those without points left alone, and whether all have settled."""
    met, moved = sums[0] > 0, centers.copy()
    moved[met] = (sums[1:3, met] * (1.0 / sums[0, met])).T
    return moved, bool((((moved - centers) ** 2).sum(axis=1) <= TOLERANCE**2).all())


def _columns(table) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("x", "y", "w")]


def _moved_at_once(points: DataFrame, first: list[np.ndarray], max_iter: int) -> list[tuple[float, np.ndarray]]:
    """Cost and centers of each start, moved to the end in one task each; for points that one task holds."""

    def run(table: pa.Table) -> pa.Table:
        start = table.column("start")[0].as_py()
        x, y, w = _columns(table)
        order = np.lexsort((y, x))
        x, y, w = x[order], y[order], w[order]
        centers, cost = first[start], 0.0
        for _ in range(max_iter):
            sums = _step(x, y, w, centers)
            cost = float(sums[3].sum())
            centers, settled = _update(centers, sums)
            if settled:
                break
        return pa.table({"start": pa.array([start], pa.int32()), "cost": [cost], "x": [centers[:, 0].tolist()], "y": [centers[:, 1].tolist()]})

    starts = F.explode(F.sequence(F.lit(0), F.lit(len(first) - 1))).alias("start")
    found = points.select(starts, "x", "y", "w").repartition(len(first), "start").groupBy("start").applyInArrow(run, "start int, cost double, x array<double>, y array<double>")
    # One short row per start.
    return [(r["cost"], np.array([r["x"], r["y"]]).T) for r in sorted(found.collect(), key=lambda r: r["start"])]


def _moved_in_turn(points: DataFrame, first: list[np.ndarray], max_iter: int) -> list[tuple[float, np.ndarray]]:
    """The same with a job for each move of all centers that have not settled."""
    centers, costs, open_ = list(first), [0.0] * len(first), list(range(len(first)))
    for _ in range(max_iter):
        if not open_:
            break
        now = [centers[start] for start in open_]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros((4, len(c))) for c in now]
            for batch in batches:
                for i, c in enumerate(now):
                    held[i] += _step(*_columns(batch), c)
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in held], pa.binary())], ["cell"])

        # A row of sums per task and start, each task's in the order of the starts.
        cells = [np.frombuffer(r["cell"]).reshape(4, -1) for r in points.select("x", "y", "w").mapInArrow(sums, "cell binary").collect()]
        left = []
        for i, start in enumerate(open_):
            total = sum(cells[i :: len(open_)])
            costs[start] = float(total[3].sum())
            centers[start], settled = _update(centers[start], total)
            left += [] if settled else [start]
        open_ = left
    return list(zip(costs, centers))


def _number(name: str) -> Column:
    """A coordinate; text that is none, and NaN, are missing."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def squared_distances(centers, lon: str = "_x", lat: str = "_y") -> list[str]:
    return [
        f"({lon} - {number(x)}) * ({lon} - {number(x)}) + ({lat} - {number(y)}) * ({lat} - {number(y)})" for x, y in centers
    ]


def nearest(centers, lon: str = "_x", lat: str = "_y") -> Column:
    """Index of the nearest center; the lowest index wins a tie."""
    squared = f"array({', '.join(squared_distances(centers, lon, lat))})"
    return F.expr(f"cast(array_position({squared}, array_min({squared})) - 1 as int)")


class GeoEncoder(Estimator):
    def __init__(
        self,
        mode: str = "raw",
        n_clusters: int = 40,
        lon: str = "longitude",
        lat: str = "latitude",
        seed: int = 12345,
        n_init: int = N_INIT,
    ):
        super().__init__()
        self.mode, self.n_clusters, self.lon, self.lat = mode, n_clusters, lon, lat
        self.seed, self.n_init = seed, n_init

    def _fit(self, dataset: DataFrame) -> "GeoEncoderModel":
        require_columns(dataset, [self.lon, self.lat])
        if self.mode not in MODES:
            raise ValueError(f"geo mode must be one of {sorted(MODES)}, not {self.mode!r}")
        if self.n_clusters < 2:
            raise ValueError("at least 2 geographic clusters are needed")
        fill, centers = {}, []
        if self.mode in CLUSTER_MODES + DISTANCE_MODES:
            # Other modes never use the fill values, so they need no pass over the data.
            fill = medians(dataset.select(*[F.col(c).try_cast("double").alias(c) for c in (self.lon, self.lat)]), [self.lon, self.lat])
            if None in fill.values():
                raise ValueError("k-means needs at least one known coordinate")
            centers = fit_centers(dataset, self.lon, self.lat, fill, self.n_clusters, self.seed, self.n_init)
        return GeoEncoderModel(self.mode, fill, centers, self.lon, self.lat)


class GeoEncoderModel(Model, MLWritable, MLReadable):
    """Applies fitted (or given) centers; everything is a column expression."""

    def __init__(self, mode="raw", fill=None, centers=(), lon="longitude", lat="latitude"):
        super().__init__()
        self.mode, self.fill, self.lon, self.lat = mode, dict(fill or {}), lon, lat
        self.centers = [tuple(c) for c in centers]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require_columns(dataset, [self.lon, self.lat])
        if self.mode not in CLUSTER_MODES + DISTANCE_MODES:
            return dataset if self.mode in RAW_MODES else dataset.drop(self.lon, self.lat)
        # Only the copies used for distances are filled; retained raw columns stay as they are.
        copies = {
            name: F.coalesce(_number(c), F.lit(float(self.fill[c])))
            for name, c in (("_x", self.lon), ("_y", self.lat))
        }
        added = {}
        if self.mode in CLUSTER_MODES:
            added["geo_cluster"] = nearest(self.centers).cast("string")
        if self.mode in DISTANCE_MODES:
            for i, squared in enumerate(squared_distances(self.centers)):
                added[f"geo_distance_{i}"] = F.expr(f"sqrt({squared})")
        frame = dataset.withColumns(copies).withColumns(added).drop("_x", "_y")
        return frame if self.mode in RAW_MODES else frame.drop(self.lon, self.lat)

    def write(self) -> MLWriter:
        return _GeoWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _GeoReader(cls)


class _GeoWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        fitted = {"mode": m.mode, "fill": m.fill, "centers": m.centers, "lon": m.lon, "lat": m.lat}
        DefaultParamsWriter.saveMetadata(m, path, SparkSession.active(), extraMetadata={"fitted": json.dumps(fitted)})


class _GeoReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        name = self.cls.__module__ + "." + self.cls.__name__
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active(), name)
        model = self.cls(**json.loads(metadata["fitted"]))
        model._resetUid(metadata["uid"])
        return model
