"""Categorical naive Bayes from grouped counts.

Input columns hold non-negative integer codes. A row is scored by looking up,
per feature, one array of log probabilities (one entry per class) and adding
the arrays, so the data is never expanded to rows x features x classes.
"""

from __future__ import annotations

import json
import math

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.functions.probability import number, numbers, softmax
from blotter.operators.lookup import attach, literal
from blotter.operators.splits import MAX_CLASSES
from blotter.session import bounded_rows, cut_lineage, fits_broadcast

INLINE_CODES = 64  # code tables up to this size become literals instead of joins


def code_counts(df: DataFrame, columns, label: str = "label") -> DataFrame:
    """Rows per (feature, code, class); combined before the shuffle."""
    pairs = ", ".join(f"named_struct('feature', '{c}', 'code', cast(`{c}` as int))" for c in columns)
    return (
        df.select(F.col(label).cast("int").alias("k"), F.expr(f"explode(array({pairs}))").alias("p"))
        .groupBy(F.col("p.feature").alias("feature"), F.col("p.code").alias("code"), "k")
        .agg(F.count("*").alias("n"))
    )


class CategoricalBayes(Estimator):
    def __init__(self, columns=None, label_col: str = "label", alpha: float = 0.5, skip=("target", "label", "incident_id")):
        super().__init__()
        self.columns, self.label_col, self.alpha, self.skip = columns, label_col, alpha, skip

    def _fit(self, dataset: DataFrame) -> "CategoricalBayesModel":
        columns = list(self.columns or [c for c in dataset.columns if c not in self.skip])
        counts = cut_lineage(code_counts(dataset, columns, self.label_col))
        # Every row has one code of the first feature, so its counts give the class sizes.
        sizes_by_class = counts.filter(F.col("feature") == columns[0]).groupBy("k").agg(F.sum("n").alias("n"))
        per_class = {r["k"]: r["n"] for r in bounded_rows(sizes_by_class, MAX_CLASSES, "classes")}
        classes = max(per_class) + 1
        spans = bounded_rows(
            counts.groupBy("feature").agg(F.max("code").alias("top"), F.count_distinct("code").alias("rows")),
            len(columns),
            "features",
        )
        sizes = {r["feature"]: (r["top"] + 1, r["rows"]) for r in spans}
        totals = [per_class.get(k, 0) for k in range(classes)]
        # The smoothed denominator of a class depends on the feature's code count only.
        floors = {
            f: [math.log(t + self.alpha * n) for t in totals] for f, (n, _) in sizes.items()
        }
        seen = F.map_from_entries(F.collect_list(F.struct("k", "n")))  # at most one entry per class
        share = F.sum("n") / F.lit(sum(totals))
        cells = ", ".join(f"ln(coalesce(seen[{k}], 0L) + {number(self.alpha)}) - floor[{k}]" for k in range(classes))
        table = (
            counts.groupBy("feature", "code")
            .agg(seen.alias("seen"), share.alias("share"))
            .withColumn("floor", literal(floors, "map<string, array<double>>")[F.col("feature")])
            .select("feature", F.col("code").alias("level"), "share", F.expr(f"array({cells})").alias("logp"))
        )
        # A code without training rows has only the smoothing mass.
        absent = {f: [math.log(self.alpha) - v for v in d] for f, d in floors.items()}
        prior = [math.log(t) - math.log(sum(totals)) if t else -math.inf for t in totals]
        return CategoricalBayesModel(columns, prior, absent, {f: r for f, (_, r) in sizes.items()}, cut_lineage(table))


class CategoricalBayesModel(Model, MLWritable, MLReadable):
    def __init__(self, columns=(), prior=(), absent=None, sizes=None, table: DataFrame | None = None):
        super().__init__()
        self.columns, self.prior = list(columns), list(prior)
        self.absent, self.sizes, self.table = absent or {}, sizes or {}, table
        self._inline = None

    def inline(self) -> dict[str, list[list[float]]]:
        """Log probabilities by code for the features with few codes, read once."""
        if self._inline is None:
            few = [c for c, rows in self.sizes.items() if rows <= INLINE_CODES]
            top = {c: {} for c in few}
            if few:
                rows = self.table.filter(F.col("feature").isin(few)).select("feature", "level", "logp")
                for r in bounded_rows(rows, INLINE_CODES * len(few), "codes"):
                    if r["level"] < INLINE_CODES:
                        top[r["feature"]][r["level"]] = list(r["logp"])
                    else:  # a code too high for a short list
                        top[r["feature"]] = {-1: None}
            self._inline = {
                c: [codes.get(i, self.absent[c]) for i in range(max(codes) + 1)] for c, codes in top.items() if -1 not in codes
            }
        return self._inline

    def log_joint(self, dataset: DataFrame) -> DataFrame:
        """Adds ``joint``: log prior plus the feature log likelihoods, per class."""
        frame, n = dataset, len(self.prior)
        names = []
        for i, c in enumerate(self.columns):
            short = self.inline().get(c)
            if short is not None:
                table, code = literal([*short, self.absent[c]], "array<array<double>>"), F.col(c).cast("int")
                slot = F.when(code.between(0, len(short) - 1), code).otherwise(len(short))
                frame = frame.withColumn(f"_lp{i}", F.element_at(table, slot + 1))
                names.append(f"_lp{i}")
                continue
            side = self.table.filter(F.col("feature") == c)
            default = F.expr(numbers(self.absent[c]))
            small = fits_broadcast(self.sizes[c], row_bytes=48 + 8 * n)
            frame = attach(frame, F.col(c).cast("int"), side, "logp", f"_lp{i}", default, small)
            names.append(f"_lp{i}")
        sums = [" + ".join([number(self.prior[k]), *(f"{name}[{k}]" for name in names)]) for k in range(n)]
        return frame.withColumn("joint", F.expr(f"array({', '.join(sums)})")).drop(*names)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return softmax(self.log_joint(dataset), len(self.prior), "joint").drop("joint")

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
        m = self.model
        fitted = {"columns": m.columns, "prior": m.prior, "absent": m.absent, "sizes": m.sizes}
        extra = {"fitted": json.dumps(fitted)}
        DefaultParamsWriter.saveMetadata(m, path, SparkSession.active(), extraMetadata=extra)
        m.table.write.mode("overwrite").parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        spark = SparkSession.active()
        name = self.cls.__module__ + "." + self.cls.__name__
        metadata = DefaultParamsReader.loadMetadata(path, spark, name)
        model = self.cls(**json.loads(metadata["fitted"]), table=spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        return model
