"""Exact quantiles of many columns without gathering a column in one task.

Columns with few distinct values are counted by value first, so ``percentile``
only sees one row per distinct value. For the others every wanted rank is
bracketed: each pass counts rows in equal slices of the bracket, and the slice
that holds the rank becomes the next bracket, until it holds a single value.
A pass moves at most ``SLICES`` counts per rank and task, whatever the data size.
NaN counts as missing everywhere; infinite values have no quantiles here and raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from blotter.session import bounded_rows

FEW_VALUES = 1_000_000
SLICES = 1024
COUNTED_VALUES = 1 << 16  # different values of a column that a task holds before it hands their counts on
METHODS = ("linear", "averaged_inverted_cdf")


def known(name: str) -> str:
    """A column as double, NaN as null."""
    return f"nullif(cast(`{name}` as double), double('NaN'))"


def value_counts(df: DataFrame, columns) -> DataFrame:
    """``feature``, ``value`` and ``n``: rows per known value of each column, counted in tasks before they are put together."""
    names = list(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in names]
        size = [0] * len(names)

        def merged(i: int) -> tuple[np.ndarray, np.ndarray]:
            values, counts = (np.concatenate(part) for part in zip(*held[i]))
            unique, place = np.unique(values, return_inverse=True)
            return unique, np.bincount(place, counts, len(unique)).astype(np.int64)

        def rows(i: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            held[i], size[i] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([names[i]] * len(values), pa.string()), pa.array(values), pa.array(counts)], ["feature", "value", "n"])

        for batch in batches:
            for i in range(len(names)):
                values, counts = np.unique(batch.column(i).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                held[i].append((values, counts))
                size[i] += len(values)
                if size[i] >= COUNTED_VALUES:
                    held[i] = [merged(i)]
                    size[i] = len(held[i][0][0])
                    if size[i] >= COUNTED_VALUES // 2:
                        yield rows(i, *held[i][0])
        for i in range(len(names)):
            if held[i]:
                yield rows(i, *merged(i))

    read = df.select(*[F.expr(known(c)).alias(f"c{i}") for i, c in enumerate(names)])
    counts = read.mapInArrow(partial, "feature string, value double, n long")
    return counts.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def counted_profile(counts: DataFrame, columns, rows: int) -> dict[str, dict]:
    """``profile`` without moments, from the counts by value of so many rows: the same numbers, as they do not depend on repeats."""
    aggregates = [F.sum("n").alias("n"), F.approx_count_distinct("value").alias("distinct"), F.min("value").alias("low"), F.max("value").alias("high")]
    found = {r["feature"]: r.asDict() for r in counts.groupBy("feature").agg(*aggregates).collect()}  # a row per column
    empty = {"n": 0, "distinct": 0, "low": None, "high": None}
    stats = {c: {k: found.get(c, empty)[k] for k in empty} for c in columns}
    _finite(stats)
    return {c: {"missing": rows - s["n"], **s} for c, s in stats.items()}


def _finite(stats: dict[str, dict]) -> None:
    endless = [c for c, s in stats.items() if {s["low"], s["high"]} & {math.inf, -math.inf}]
    if endless:
        raise ValueError(f"infinite values in {endless}")


def wanted_ranks(n: int, prob: float, method: str) -> tuple[int, int, float]:
    """Zero-based lower and upper rank and the weight of the upper one."""
    if method not in METHODS:
        raise ValueError(f"quantile method must be one of {METHODS}")
    if method == "linear":
        place = (n - 1) * prob
        low = math.floor(place)
        return low, min(low + 1, n - 1), place - low
    place = n * prob
    low = math.floor(place)
    if place == low:  # on a step of the distribution function: the mean of both sides
        return max(low - 1, 0), min(low, n - 1), 0.5
    return min(low, n - 1), min(low, n - 1), 0.0


def _mix(values: dict, ranks) -> float:
    low, high, weight = ranks
    return values[low] + (values[high] - values[low]) * weight if weight else values[low]


def _ranks_by_value(df: DataFrame, plan: dict[str, set[int]], counts: DataFrame | None = None) -> dict:
    """Order statistics through one row per distinct value."""
    counts = value_counts(df, sorted(plan)) if counts is None else counts.filter(F.col("feature").isin(sorted(plan)))
    wanted = {c: np.array(sorted(ranks)) for c, ranks in plan.items()}

    def hits(table: pa.Table) -> pa.Table:
        # A row per distinct value; the value at a rank is the first whose running count exceeds it.
        feature = table.column("feature")[0].as_py()
        values, counts = (table.column(c).to_numpy() for c in ("value", "n"))
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(np.cumsum(counts[order]), wanted[feature], "right")
        ranks, found = wanted[feature][at < len(values)], values[order][at[at < len(values)]]
        return pa.table([pa.array([feature] * len(ranks), pa.string()), pa.array(ranks, pa.int64()), pa.array(found)], ["feature", "rank", "value"])

    rows = counts.groupBy("feature").applyInArrow(hits, "feature string, rank long, value double").collect()
    return {(r["feature"], r["rank"]): r["value"] for r in rows}


def _ranks_by_bracket(df: DataFrame, plan: dict[str, set[int]], spans: dict[str, tuple[float, float]]) -> dict:
    """Order statistics by narrowing a bracket around each rank."""
    found, open_ = {}, {}
    for column, ranks in plan.items():
        low, high = spans[column]
        for rank in ranks:
            if low == high:
                found[column, rank] = low
            else:
                open_[column, rank] = (low, high, rank)
    while open_:
        keys = sorted(open_)
        slots = []
        for i, (column, _) in enumerate(keys):
            low, high, _ = open_[column, keys[i][1]]
            value = F.expr(known(column))
            # Halves keep the width of the widest bracket finite; a bracket of two neighbours is too narrow for halves.
            wide = max(abs(low), abs(high)) > 1e300
            part = (value / 2 - low / 2) / (high / 2 - low / 2) if wide else (value - low) / (high - low)
            slot = F.least(F.floor(part * SLICES), F.lit(SLICES - 1)).cast("int")
            entry = F.struct(F.lit(i).alias("i"), slot.alias("slot"), value.alias("value"))
            slots.append(F.when((value >= low) & (value <= high), entry))
        used = sorted({c for c, _ in keys})
        counts = (
            df.select(*used)
            .select(F.explode(F.array_compact(F.array(*slots))).alias("e"))
            .groupBy("e.i", "e.slot")
            .agg(F.count("*").alias("n"), F.min("e.value").alias("low"), F.max("e.value").alias("high"))
        )
        offset = F.array(*[F.lit(open_[k][2]).cast("bigint") for k in keys])
        hit = (
            counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("slot")))
            .withColumn("left", offset[F.col("i")] - (F.col("upto") - F.col("n")))
            .filter((F.col("left") >= 0) & (F.col("left") < F.col("n")))
        )
        for r in hit.collect():  # one row per open rank
            key = keys[r["i"]]
            if r["low"] == r["high"]:
                found[key] = r["low"]
                del open_[key]
            elif (r["low"], r["high"]) == open_[key][:2]:
                raise ArithmeticError(f"{key[0]}: no slice of {open_[key][:2]} is narrower")
            else:
                open_[key] = (r["low"], r["high"], r["left"])
    return found


def profile(df: DataFrame, columns) -> dict[str, dict]:
    """Known and missing values, distinct estimate, range and moments per column, from one scan."""
    columns = list(columns)
    kinds = {
        "n": "count",
        "distinct": "approx_count_distinct",
        "low": "min",
        "high": "max",
        "mean": "avg",
        "var": "var_pop",
    }
    stats = lambda c: ", ".join(f"'{k}', {f}({c})" for k, f in kinds.items())
    # A column is read once for all its aggregates.
    read = df.select(*[F.expr(known(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    row = read.agg(F.count("*").alias("rows"), *[F.expr(f"named_struct({stats(f'c{i}')})").alias(f"c{i}") for i in range(len(columns))]).first()
    _finite({c: row[f"c{i}"] for i, c in enumerate(columns)})
    return {c: {"missing": row["rows"] - row[f"c{i}"]["n"], **row[f"c{i}"].asDict()} for i, c in enumerate(columns)}


def order_statistics(df: DataFrame, plan: dict[str, set[int]], stats: dict[str, dict], few_values: int = FEW_VALUES, counts: DataFrame | None = None) -> dict:
    """Values at the wanted zero-based ranks, keyed by (column, rank). ``counts`` holds the ``value_counts`` where they are known."""
    few = {c: k for c, k in plan.items() if stats[c]["distinct"] <= few_values}
    many = {c: k for c, k in plan.items() if c not in few}
    values = _ranks_by_value(df, few, counts) if few else {}
    if many:
        values.update(_ranks_by_bracket(df, many, {c: (stats[c]["low"], stats[c]["high"]) for c in many}))
    return values


def exact_quantiles(
    df: DataFrame,
    columns,
    probs,
    method: str = "linear",
    few_values: int = FEW_VALUES,
) -> dict[str, list[float] | None]:
    """Quantiles per column over its non-null values; ``None`` for an all-null column."""
    columns = list(columns)
    if not columns:
        return {}
    stats = profile(df, columns)
    ranks = {c: [wanted_ranks(stats[c]["n"], p, method) for p in probs] for c in columns if stats[c]["n"]}
    plan = {c: {k for r in wanted for k in r[:2]} for c, wanted in ranks.items()}
    values = order_statistics(df, plan, stats, few_values)
    return {
        c: [_mix({k: values[c, k] for k in r[:2]}, r) for r in ranks[c]] if c in ranks else None for c in columns
    }


def grouped_quantiles(df: DataFrame, group: str, value: str, probs, limit: int = 100_000, weight: str | None = None) -> dict:
    """Linear quantiles of ``value`` per group, ``{group: [quantile, ...]}``; no group is gathered or sorted.

    Every wanted rank of every group has a bracket; a pass counts rows in slices of all brackets at once. Null and NaN are
    missing, a group without values is left out, infinite values raise. At most ``limit`` groups, whose brackets are
    broadcast. ``weight`` names the number of times a row counts.
    """
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(F.col(group).alias("g"), F.expr(known(value)).alias("v"), times.alias("w")).filter("v is not null")
    stats = bounded_rows(rows.groupBy("g").agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), limit, "groups")
    if any(math.isinf(s["low"]) or math.isinf(s["high"]) for s in stats):
        raise ValueError(f"infinite values in {value}")
    ranks = {s["g"]: [wanted_ranks(s["n"], p, "linear") for p in probs] for s in stats}
    found, open_ = {}, {}
    for s in stats:
        for rank in {k for r in ranks[s["g"]] for k in r[:2]}:
            if s["low"] == s["high"]:
                found[s["g"], rank] = s["low"]
            else:
                open_[s["g"], rank] = (s["low"], s["high"], rank)
    schema = T.StructType([T.StructField("g", rows.schema["g"].dataType), *(T.StructField(n, t) for n, t in (("i", T.IntegerType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("rank", T.LongType())))])
    while open_:
        keys = list(open_)
        table = df.sparkSession.createDataFrame([(g, i, *open_[g, k]) for i, (g, k) in enumerate(keys)], schema)
        # Halves keep the widest bracket finite; narrow ones are taken as they are.
        part = F.expr("if(greatest(abs(low), abs(high)) > 1e300, (v / 2 - low / 2) / (high / 2 - low / 2), (v - low) / (high - low))")
        slot = F.least(F.floor(part * SLICES), F.lit(SLICES - 1)).cast("int")
        held = rows.join(F.broadcast(table), rows["g"].eqNullSafe(table["g"])).filter("v >= low and v <= high")
        counts = held.groupBy("i", "rank", slot.alias("slot")).agg(F.sum("w").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("slot"))
        hit = counts.withColumn("left", F.col("rank") - (upto - F.col("n"))).filter("left >= 0 and left < n")
        for r in hit.select("i", "first", "last", "left").collect():  # one row per open rank
            key = keys[r["i"]]
            if r["first"] == r["last"]:
                found[key] = r["first"]
                del open_[key]
            elif (r["first"], r["last"]) == open_[key][:2] and r["left"] == open_[key][2]:
                raise ArithmeticError(f"no slice of {open_[key][:2]} is narrower")
            else:
                open_[key] = (r["first"], r["last"], r["left"])
    return {g: [_mix({k: found[g, k] for k in r[:2]}, r) for r in wanted] for g, wanted in ranks.items()}


def medians(df: DataFrame, columns) -> dict[str, float | None]:
    return {c: q[0] if q else None for c, q in exact_quantiles(df, columns, [0.5]).items()}


def imputed_quantiles(
    df: DataFrame,
    stats: dict[str, dict],
    probs=(),
    method: str = "linear",
    few_values: int = FEW_VALUES,
    counts: DataFrame | None = None,
) -> dict[str, tuple[float, list[float]]]:
    """Median of each column, and quantiles of the column with its gaps filled by that median.

    Filling m gaps puts m copies of the median behind the lower middle rank, so
    a rank of the filled column is a rank of the known values, or the median.
    All of it is read in one pass.
    """
    middle, ranks, plan = {}, {}, {}
    for c, s in stats.items():
        if not s["n"]:
            continue
        middle[c] = wanted_ranks(s["n"], 0.5, "linear")
        ranks[c] = [wanted_ranks(s["n"] + s["missing"], p, method) for p in probs]
        wanted = {k for r in ranks[c] for k in r[:2]}
        plan[c] = set(middle[c][:2]) | {_known_rank(k, middle[c][0], s["missing"]) for k in wanted} - {None}
    values = order_statistics(df, plan, stats, few_values, counts) if plan else {}
    found = {}
    for c, m in middle.items():
        median = _mix({k: values[c, k] for k in m[:2]}, m)

        def at(k):
            known = _known_rank(k, m[0], stats[c]["missing"])
            return median if known is None else values[c, known]

        found[c] = (median, [_mix({k: at(k) for k in r[:2]}, r) for r in ranks[c]])
    return found


def _known_rank(rank: int, middle: int, missing: int) -> int | None:
    """Rank among the known values, or ``None`` inside the run of filled gaps."""
    if rank <= middle:
        return rank
    return None if rank <= middle + missing else rank - missing
