"""Fitted column transforms: one estimator for the numeric and categorical blocks."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from blotter.functions.probability import number
from blotter.operators.levels import MISSING, Levels, fit_levels
from blotter.operators.lookup import attach, inlined
from blotter.operators.quantiles import FEW_VALUES, counted_profile, imputed_quantiles, known, profile, value_counts
from blotter.session import bounded_rows, cached

NUMERIC_STRATEGIES = ("standard", "robust", "passthrough", "binned")
ENCODINGS = ("onehot", "ordinal", "frequency")
MIN_BIN_WIDTH = 1e-8
MAX_SLOTS = 1_000_000  # slot names a list may hold


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    """Numeric and boolean columns, in frame order."""
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def categorical_columns(df: DataFrame, skip=()) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric and c not in skip]


def add_constant(column: Column, constant: float = 1.0) -> Column:
    return column + F.lit(constant)


# --- numeric block ---------------------------------------------------------


def bin_edges(quantiles: list[float]) -> list[float]:
    """Edges with bins too narrow to tell apart removed."""
    kept = quantiles[:1]
    for low, high in zip(quantiles, quantiles[1:]):
        if high - low > MIN_BIN_WIDTH:
            kept.append(high)
    return kept


def fit_numeric(
    df: DataFrame,
    columns,
    strategy: str,
    bins: int = 10,
    quantile_method: str = "averaged_inverted_cdf",
) -> dict[str, dict]:
    """Parameters per column. Columns without any value are left out.

    Scales and bins are those of the *imputed* column, all rows taken in.
    """
    if strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"numeric strategy must be one of {NUMERIC_STRATEGIES}, not {strategy!r}")
    if strategy == "binned" and bins < 2:
        raise ValueError("at least 2 bins are needed")
    columns = list(columns)
    if not columns:
        return {}
    probs = {"robust": [0.25, 0.5, 0.75], "binned": [i / bins for i in range(bins + 1)]}.get(strategy, [])
    method = quantile_method if strategy == "binned" else "linear"
    rows = df.count()
    if strategy == "standard" or rows > FEW_VALUES:
        return _fitted(strategy, imputed_quantiles(df, stats := profile(df, columns), probs, method), stats)
    # One pass counts the values of all columns, the rest is read off the counts.
    with cached(value_counts(df, columns)) as counts:
        stats = counted_profile(counts, columns, rows)
        return _fitted(strategy, imputed_quantiles(df, stats, probs, method, counts=counts), stats)


def _fitted(strategy: str, found: dict[str, tuple[float, list[float]]], stats: dict[str, dict]) -> dict[str, dict]:
    fitted = {}
    for c, (median, quantiles) in found.items():
        fitted[c] = {"median": median}
        if strategy == "standard":
            center, scale = _filled_moments(stats[c], median)
            fitted[c].update(center=center, scale=scale or 1.0)
        elif strategy == "robust":
            q1, q2, q3 = quantiles
            fitted[c].update(center=q2, scale=(q3 - q1) or 1.0)
        elif strategy == "binned":
            fitted[c]["edges"] = bin_edges(quantiles)
    return fitted


def _filled_moments(s: dict, median: float) -> tuple[float, float]:
    """Mean and population deviation after the gaps got the median."""
    n, m = s["n"], s["missing"]
    mean = (n * s["mean"] + m * median) / (n + m)
    squares = n * (s["var"] + (s["mean"] - mean) ** 2) + m * (median - mean) ** 2
    return mean, (squares / (n + m)) ** 0.5


def numeric_expression(name: str, params: dict) -> Column:
    value = f"coalesce({known(name)}, {number(params['median'])})"
    if "edges" in params:
        return F.expr(" + ".join(f"cast({value} >= {number(e)} as int)" for e in params["edges"][1:-1]) or "0")
    if "center" in params:
        return F.expr(f"({value} - {number(params['center'])}) / {number(params['scale'])}")
    return F.expr(value)


# --- both blocks -----------------------------------------------------------


class ColumnEncoder(Estimator):
    """Learns the numeric and categorical transforms from the training rows only.

    ``skip`` names columns that are carried along untouched (keys, target,
    label, timestamps). ``output`` is ``vector`` for one assembled column or
    ``columns`` to keep one encoded column per predictor. ``shift`` adds a
    constant to ordinal codes, so that unknown becomes 0.
    """

    def __init__(
        self,
        numeric: str = "standard",
        categorical: str = "onehot",
        bins: int = 10,
        skip=("target", "label", "incident_id"),
        output: str = "vector",
        features_col: str = "features",
        shift: int = 0,
        sparse: bool = True,
        quantile_method: str = "averaged_inverted_cdf",
    ):
        super().__init__()
        if categorical not in ENCODINGS:
            raise ValueError(f"categorical encoding must be one of {ENCODINGS}, not {categorical!r}")
        if numeric not in NUMERIC_STRATEGIES:
            raise ValueError(f"numeric strategy must be one of {NUMERIC_STRATEGIES}, not {numeric!r}")
        if numeric == "binned" and bins < 2:
            raise ValueError("at least 2 bins are needed")
        self.settings = {
            "numeric": numeric,
            "categorical": categorical,
            "bins": bins,
            "skip": list(skip),
            "output": output,
            "features_col": features_col,
            "shift": shift,
            "sparse": sparse,
            "quantile_method": quantile_method,
        }

    def _fit(self, dataset: DataFrame) -> "ColumnEncoderModel":
        s = self.settings
        numeric = numeric_columns(dataset, s["skip"])
        categorical = categorical_columns(dataset, s["skip"])
        params = fit_numeric(dataset, numeric, s["numeric"], s["bins"], s["quantile_method"])
        levels = fit_levels(dataset, categorical) if categorical else None
        return ColumnEncoderModel(s, numeric, categorical, params, levels)


class ColumnEncoderModel(Model, MLWritable, MLReadable):
    def __init__(self, settings=None, numeric=None, categorical=None, params=None, levels: Levels | None = None):
        super().__init__()
        self.settings = settings or {}
        self.numeric = list(numeric or [])
        self.categorical = list(categorical or [])
        self.numeric_params = params or {}
        self.levels = levels

    @property
    def used_numeric(self) -> list[str]:
        return [c for c in self.numeric if c in self.numeric_params]

    @property
    def encoded_columns(self) -> list[str]:
        """Predictors in output order: the numeric block first."""
        return self.used_numeric + self.categorical

    def width(self) -> int:
        """Number of slots of the assembled vector."""
        if self.settings["categorical"] != "onehot":
            return len(self.encoded_columns)
        return len(self.used_numeric) + sum(self.levels.count(c) for c in self.categorical)

    def slot_names(self) -> list[str]:
        """Name of every slot of the vector, in order: a one-hot slot is ``column=level``."""
        rows = bounded_rows(self.slots(), MAX_SLOTS, "slots")
        return [r["name"] for r in sorted(rows, key=lambda r: r["slot"])]

    def slots(self) -> DataFrame:
        """``slot`` and ``name`` as a table, for vectors too wide for a list."""
        spark = SparkSession.active()
        plain = self.encoded_columns if self.settings["categorical"] != "onehot" else self.used_numeric
        table = spark.createDataFrame(list(enumerate(plain)), "slot long, name string")
        at = len(plain)
        for c in self.categorical if self.settings["categorical"] == "onehot" else ():
            own = self.levels.of(c).select((F.col("code") + at).cast("long").alias("slot"), F.concat(F.lit(f"{c}="), "level").alias("name"))
            table, at = table.unionByName(own), at + self.levels.count(c)
        return table

    def _check(self, df: DataFrame) -> None:
        missing = [c for c in self.encoded_columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns seen when fitting are missing: {missing}")

    def encode(self, df: DataFrame) -> DataFrame:
        """Replace every predictor by its encoded value."""
        self._check(df)
        kind, shift = self.settings["categorical"], self.settings["shift"]
        extra = [c for c in self.numeric if c not in self.numeric_params and c in df.columns]
        frame = df.withColumns({c: numeric_expression(c, self.numeric_params[c]) for c in self.used_numeric}).drop(*extra)
        for c in self.categorical:
            key = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            if kind == "frequency":
                value, default = "share", 0.0
            else:
                value, default = "code", -1 if kind == "ordinal" else self.levels.count(c)
            short = self.levels.inline().get(c)
            if short is not None:
                frame = frame.withColumn(c, inlined(key, [k for k, _, _ in short], [r[2 if value == "share" else 1] for r in short], default))
            else:
                frame = attach(frame, key, self.levels.of(c), value, c, default, self.levels.small(c))
            if kind == "ordinal" and shift:
                frame = frame.withColumn(c, add_constant(F.col(c), shift).cast("int"))
        return frame

    def one_hot(self, df: DataFrame) -> DataFrame:
        """Predictors encoded, each categorical one as a sparse vector ``<name>__hot``."""
        return self._one_hot(self.encode(df))

    def _one_hot(self, frame: DataFrame) -> DataFrame:
        # The slot after the last level stands for "unknown"; dropping it leaves
        # an empty vector for unseen values while every level keeps its slot.
        marked = frame.withColumns(
            {c: F.col(c).cast("double") for c in self.categorical}
        )
        for c in self.categorical:
            attribute = {"ml_attr": {"type": "nominal", "name": c, "num_vals": self.levels.count(c) + 1}}
            marked = marked.withMetadata(c, attribute)
        hot = [f"{c}__hot" for c in self.categorical]
        encoder = OneHotEncoder(inputCols=self.categorical, outputCols=hot, dropLast=True, handleInvalid="error")
        return encoder.fit(marked).transform(marked).drop(*self.categorical)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        frame = self.encode(dataset)
        if self.settings["output"] == "columns":
            return frame
        inputs = list(self.encoded_columns)
        if self.settings["categorical"] == "onehot" and self.categorical:
            frame = self._one_hot(frame)
            inputs = self.used_numeric + [f"{c}__hot" for c in self.categorical]
        assembler = VectorAssembler(inputCols=inputs, outputCol=self.settings["features_col"], handleInvalid="error")
        frame = assembler.transform(frame).drop(*inputs)
        if not self.settings["sparse"]:
            name = self.settings["features_col"]
            frame = frame.withColumn(name, array_to_vector(vector_to_array(name)))
        return frame

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(MLWriter):
    def __init__(self, model: ColumnEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        fitted = {
            "settings": m.settings,
            "numeric": m.numeric,
            "categorical": m.categorical,
            "numeric_params": m.numeric_params,
            "sizes": m.levels.sizes if m.levels else None,
        }
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"fitted": json.dumps(fitted)})
        if m.levels:
            m.levels.table.write.mode("overwrite").parquet(f"{path}/levels")


class _EncoderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ColumnEncoderModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark, self.cls.__module__ + "." + self.cls.__name__)
        fitted = json.loads(metadata["fitted"])
        levels = None
        if fitted["sizes"] is not None:
            sizes = {k: tuple(v) for k, v in fitted["sizes"].items()}
            levels = Levels(spark.read.parquet(f"{path}/levels"), sizes)
        model = self.cls(fitted["settings"], fitted["numeric"], fitted["categorical"], fitted["numeric_params"], levels)
        model._resetUid(metadata["uid"])
        return model
