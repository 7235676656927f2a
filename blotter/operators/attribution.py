"""Feature importances and attributions in long form (row, feature, class, phi)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F, types as T

from blotter.functions.probability import number
from blotter.operators.quantiles import grouped_quantiles
from blotter.operators.splits import HASH_RANGE, row_hash
from blotter.session import cut_lineage

SAMPLE_SIZE = 2000


def reproducible_sample(df: DataFrame, key: str, size: int = SAMPLE_SIZE, seed: int = 12345) -> DataFrame:
    """``min(size, rows)`` rows without replacement: those with the smallest key hash.

    Rows are counted under a hash threshold that should leave about twice the
    sample, widened until it holds enough, so only those are ordered.
    """
    hashed = df.withColumn("_h", row_hash(key, seed))
    rows = df.count()
    bound = HASH_RANGE
    if rows > 4 * size:
        bound = int(HASH_RANGE * 2 * size / rows) + 1
        while bound < HASH_RANGE and hashed.filter(F.col("_h") < bound).count() < size:
            bound = min(HASH_RANGE, 4 * bound)
    return hashed.filter(F.col("_h") < bound).orderBy("_h", key).limit(size).drop("_h")


def tree_importance(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Split count, mean gain and mean cover per feature of a node table; ``f{i}`` without names."""
    inner = nodes.filter("feature >= 0").select(F.col("feature").alias("i"), "gain", "cover")
    sums = inner.groupBy("i").agg(F.count("*").alias("weight"), F.avg("gain").alias("gain"), F.avg("cover").alias("cover"))
    if not names:
        return sums.select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), "weight", "gain", "cover")
    table = nodes.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string")
    return sums.join(table, "i").select("feature", "weight", "gain", "cover")


def top_features(importance: DataFrame, kind: str = "gain", top: int = 20) -> DataFrame:
    if kind not in ("weight", "gain", "cover"):
        raise ValueError("kind must be weight, gain or cover")
    return importance.select("feature", F.col(kind)).orderBy(F.desc(kind), "feature").limit(top)


def linear_contributions(
    df: DataFrame,
    key: str,
    columns: list[str],
    weights: list[list[float]],
    means: dict[str, float],
) -> DataFrame:
    """w_jk * (x_j - mean_j): the exact Shapley values of a linear margin."""
    entries = ", ".join(
        f"named_struct('feature', '{c}', 'class_id', {k}, 'phi', {number(row[j])} * (`{c}` - {number(means[c])}))"
        for k, row in enumerate(weights)
        for j, c in enumerate(columns)
    )
    return df.select(key, F.expr(f"explode(array({entries}))").alias("e")).select(key, "e.*")


def sampled_shapley(
    sample: DataFrame,
    key: str,
    score: Callable[[DataFrame], DataFrame],
    width: int,
    classes: int,
    permutations: int = 8,
    seed: int = 12345,
    names: list[str] | None = None,
    limit: int = 100 * SAMPLE_SIZE,
) -> DataFrame:
    """Permutation-sampling Shapley values of any scorer; ``names`` are those of the features (``f{i}`` without).

    ``sample`` has ``key`` and ``x`` (array of ``width`` feature values); its size
    is what bounds the work. For each row and permutation another sampled row is
    the background; features are switched over one by one in permuted order,
    the hybrids are scored in one batch, and every hybrid adds to the feature
    just switched and subtracts from the one switched next.
    """
    if names is not None and len(names) != width:
        raise ValueError(f"{len(names)} names for {width} features")
    if sample.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows are no sample")
    # Positions come from a window over the sample, whose size was checked.
    order = Window.partitionBy(F.lit(0)).orderBy("_h", key)
    everyone = Window.partitionBy(F.lit(0))
    placed = (
        sample.withColumn("_h", row_hash(key, seed))
        .withColumn("_at", F.row_number().over(order) - 1)
        .withColumn("_rows", F.count("*").over(everyone))
    )
    turns = F.explode(F.sequence(F.lit(1), F.lit(permutations)))
    features = F.sequence(F.lit(0), F.lit(width - 1))
    drawn = F.transform(features, lambda j: F.struct(F.xxhash64(F.col(key), F.col("turn"), j, F.lit(seed)).alias("h"), j.alias("j")))
    paired = (
        placed.withColumn("turn", turns)
        .withColumn("_other", F.pmod(F.col("_at") + F.pmod(F.col("turn") * 7919, F.col("_rows")), F.col("_rows")))
        .withColumn("order", F.transform(F.array_sort(drawn), lambda e: e["j"]))
    )
    background = placed.select(F.col("_at").alias("_other"), F.col("x").alias("b"))
    both = paired.join(background, "_other").select(key, "turn", "order", "x", "b")
    step = F.explode(F.sequence(F.lit(0), F.lit(width)))
    hybrids = both.withColumn("step", step)
    mixed = F.transform(
        features,
        lambda j: F.when(F.array_position(F.col("order"), j) <= F.col("step"), F.element_at(F.col("x"), j + 1)).otherwise(
            F.element_at(F.col("b"), j + 1)
        ),
    )
    scored = score(hybrids.select(key, "turn", "step", "order", array_to_vector(mixed).alias("features")))
    plus = F.when(F.col("step") > 0, F.struct(F.element_at("order", F.when(F.col("step") > 0, F.col("step")).otherwise(1)).alias("j"), F.lit(1.0).alias("sign")))
    minus = F.when(
        F.col("step") < width,
        F.struct(F.element_at("order", F.least(F.col("step") + 1, F.lit(width))).alias("j"), F.lit(-1.0).alias("sign")),
    )
    parts = scored.select(key, "probability", F.explode(F.array_compact(F.array(plus, minus))).alias("e"))
    sums = parts.groupBy(key, F.col("e.j").alias("feature_index")).agg(
        *[(F.sum(F.col("e.sign") * F.col("probability")[k]) / permutations).alias(f"phi{k}") for k in range(classes)]
    )
    out = F.array(*[F.struct(F.lit(k).alias("class_id"), F.col(f"phi{k}").alias("phi")) for k in range(classes)])
    name = F.concat(F.lit("f"), F.col("feature_index").cast("string"))
    if names is not None:
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature_index") + 1)
    return sums.select(key, name.alias("feature"), F.explode(out).alias("c")).select(key, "feature", "c.class_id", "c.phi")


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution over rows and classes, ranked from 1."""
    per_feature = contributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_absolute_shap"))
    # One row per feature: the unpartitioned window is bounded by the feature list.
    order = Window.orderBy(F.desc("mean_absolute_shap"), "feature")
    return per_feature.withColumn("rank", F.row_number().over(order))


def class_slice(contributions: DataFrame, class_id: int, classes: int) -> DataFrame:
    if not 0 <= class_id < classes:
        raise ValueError(f"class {class_id} is not among the {classes} classes")
    return contributions.filter(F.col("class_id") == class_id)


def class_id_of(name: str, classes: list[str]) -> int:
    if name not in classes:
        raise ValueError(f"class {name!r} is not among the classes")
    return classes.index(name)


def distribution(one_class: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Spread of the contributions per feature; quantiles are exact, and no feature is gathered in one task.

    The contributions are read once, into counts by value; all passes go over those.
    """
    counted = cut_lineage(one_class.groupBy("feature", "phi").agg(F.count("*").alias("n")))
    known = F.sum(F.when(F.col("phi").isNotNull(), F.col("n")))
    spread = counted.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.min("phi").alias("low"), F.max("phi").alias("high"), (F.sum(F.abs("phi") * F.col("n")) / known).alias("mean_abs")
    )
    found = grouped_quantiles(counted, "feature", "phi", probs, weight="n")
    names = [f"q{round(p * 100)}" for p in probs]
    schema = T.StructType([one_class.schema["feature"], *(T.StructField(n, T.DoubleType()) for n in names)])
    table = one_class.sparkSession.createDataFrame([(f, *q) for f, q in found.items()], schema)
    return spread.join(F.broadcast(table), "feature").select("feature", "rows", "low", "high", "mean_abs", *names)
