"""Class-prior baseline: every row gets the training class shares."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.functions.probability import numbers
from blotter.operators.splits import MAX_CLASSES
from blotter.session import bounded_rows


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    """Rows per class index; one row per class reaches the driver."""
    rows = bounded_rows(df.groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n")), MAX_CLASSES, "classes")
    return {r["k"]: r["n"] for r in sorted(rows)}


class ClassPrior(Estimator):
    def __init__(self, label_col: str = "label"):
        super().__init__()
        self.label_col = label_col

    def _fit(self, dataset: DataFrame) -> "ClassPriorModel":
        counts = class_counts(dataset, self.label_col)
        if not counts:
            raise ValueError("no training rows")
        rows = sum(counts.values())
        return ClassPriorModel([counts.get(k, 0) / rows for k in range(max(counts) + 1)])


class ClassPriorModel(Model, MLWritable, MLReadable):
    def __init__(self, priors=()):
        super().__init__()
        self.priors = list(priors)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # A literal, so scoring adds no join and no shuffle.
        return dataset.withColumn("probability", F.expr(numbers(self.priors)))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        extra = {"fitted": json.dumps(self.model.priors)}
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active(), extraMetadata=extra)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        name = self.cls.__module__ + "." + self.cls.__name__
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active(), name)
        model = self.cls(json.loads(metadata["fitted"]))
        model._resetUid(metadata["uid"])
        return model
