"""Logistic regression from MLlib, with the reference settings mapped."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, functions as F

from blotter.models.prior import class_counts

WEIGHT = "_weight"


def balanced_weights(counts: dict[int, int]) -> dict[int, float]:
    rows = sum(counts.values())
    return {k: rows / (len(counts) * n) for k, n in counts.items() if n}


def with_weight(df: DataFrame, weights: dict[int, float], label: str = "label") -> DataFrame:
    table = F.array(*[F.lit(float(weights.get(k, 0.0))) for k in range(max(weights) + 1)])
    return df.withColumn(WEIGHT, F.element_at(table, F.col(label).cast("int") + 1))


class MultinomialLogistic(Estimator):
    """Penalised maximum likelihood; ``c`` weighs the summed loss as in C * sum + penalty.

    MLlib minimises the *mean* loss, hence regParam = 1 / (c * rows). Features
    are scaled before, so MLlib's own standardisation is off.
    """

    def __init__(self, c=0.1, l1_ratio=0.0, max_iter=500, tol=1e-4, class_weight=None, label_col="label", features_col="features"):
        super().__init__()
        self.c, self.l1_ratio, self.max_iter, self.tol = c, l1_ratio, max_iter, tol
        self.class_weight, self.label_col, self.features_col = class_weight, label_col, features_col

    def _fit(self, dataset: DataFrame):
        counts = class_counts(dataset, self.label_col)
        if len(counts) < 2:
            raise ValueError("logistic regression needs training rows of at least two classes")
        estimator = LogisticRegression(
            family="multinomial",
            featuresCol=self.features_col,
            labelCol=self.label_col,
            regParam=1.0 / (self.c * sum(counts.values())),
            elasticNetParam=self.l1_ratio,
            maxIter=self.max_iter,
            tol=self.tol,
            standardization=False,
        )
        if self.class_weight == "balanced":
            dataset = with_weight(dataset, balanced_weights(counts), self.label_col)
            estimator = estimator.setWeightCol(WEIGHT)
        return estimator.fit(dataset)
