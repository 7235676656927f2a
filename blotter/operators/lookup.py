"""Joining a fitted level table to rows, safe against hot keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

# So many of the most frequent keys of the rows that are looked up are served by a broadcast.
HOT_KEYS = 5000


def attach(
    df: DataFrame,
    key: Column,
    levels: DataFrame,
    value: str,
    name: str,
    default,
    small: bool,
) -> DataFrame:
    """Add ``name`` = value of the row's level, or ``default`` when it has none.

    ``levels`` has unique ``level`` values and a ``value`` column. ``small`` says
    that its size was checked and fits a broadcast. Otherwise the keys of ``df``
    itself are counted, partly before the shuffle; the most frequent ones, with
    their value or without, are broadcast, and the rows they serve join the
    remaining levels under a spread-out dummy key. So no task receives a hot key,
    also when it was rare in training or is no level at all.
    """
    fallback = default if isinstance(default, Column) else F.lit(default)
    keyed = df.withColumn("_key", key)
    if small:
        side = levels.select(F.col("level").alias("_level"), F.col(value).alias("_value"))
        joined = keyed.join(F.broadcast(side), F.col("_key").eqNullSafe(F.col("_level")), "left")
        return joined.withColumn(name, F.coalesce("_value", fallback)).drop("_key", "_level", "_value")

    often = df.groupBy(key.alias("_hot")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_hot").limit(HOT_KEYS).drop("_n")
    known = levels.select(F.col("level").alias("_level"), F.col(value).alias("_hot_value"))
    hot = often.join(known, F.col("_hot").eqNullSafe(F.col("_level")), "left").drop("_level")
    cold = levels.select(
        F.col("level").alias("_level"), F.lit(0).cast("bigint").alias("_cold_salt"), F.col(value).alias("_value")
    )
    joined = keyed.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), F.col("_key").eqNullSafe(F.col("_hot")), "left")
    served = F.col("_is_hot").isNotNull()
    # Any hash will do: no level has a dummy key, so the spread needs no bound.
    spread = F.xxhash64(*[c for c in df.columns if _hashable(df, c)])
    joined = joined.withColumn("_salt", F.when(served, spread).otherwise(F.lit(0).cast("bigint"))).withColumn(
        "_cold_key", F.when(served, F.lit(None)).otherwise(F.col("_key"))
    )
    joined = joined.join(
        cold, (F.col("_cold_key").eqNullSafe(F.col("_level"))) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    found = F.coalesce(F.when(served, F.col("_hot_value")).otherwise(F.col("_value")), fallback)
    return joined.withColumn(name, found).drop(
        "_key", "_hot", "_is_hot", "_hot_value", "_salt", "_cold_key", "_level", "_cold_salt", "_value"
    )


def literal(values, kind: str) -> Column:
    """A nested literal from one JSON text; the optimiser folds it into a constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def inlined(key: Column, levels: list, values: list, default) -> Column:
    """Value of a level looked up in a short literal list; null is a level like any other."""
    kind = "array<double>" if isinstance(default, float) else "array<int>"
    fallback = F.lit(default)
    found = F.coalesce(F.array_position(literal([v for v in levels if v is not None], "array<string>"), key), F.lit(0))
    known = literal([v for k, v in zip(levels, values) if k is not None], kind)
    value = F.when(found > 0, F.element_at(known, F.greatest(found, F.lit(1)).cast("int"))).otherwise(fallback)
    if None in levels:
        value = F.when(key.isNull(), F.lit(values[levels.index(None)])).otherwise(value)
    return value


def _hashable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "udt", "vector", "variant")
