"""Random, frozen and calendar splits.

No split sorts the data: a time split is a range predicate, and the random
split is a hash threshold per class.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from blotter.schema import require_columns
from blotter.session import bounded_rows, cut_lineage, fits_broadcast

MAX_CLASSES = 4096
HASH_RANGE = 2147483647  # a prime below 2**31, so products stay inside 64 bits


def row_hash(key: str, seed: int) -> Column:
    """An arithmetic hash of an integer key, the same in every SQL engine."""
    k = F.pmod(F.col(key).cast("bigint"), F.lit(HASH_RANGE))
    first = F.pmod(k * 48271 + F.lit(seed), F.lit(HASH_RANGE))
    return F.pmod(first * 69621 + F.lit(seed), F.lit(HASH_RANGE))


def class_list(df: DataFrame, target: str = "target") -> list:
    """Sorted distinct classes; the count is checked against a bound."""
    rows = bounded_rows(df.select(target).filter(F.col(target).isNotNull()).distinct(), MAX_CLASSES, "classes")
    return sorted(r[0] for r in rows)


def random_split(
    df: DataFrame,
    key: str,
    target: str = "target",
    test_size: float = 0.40,
    seed: int = 12345,
    slices: int = 4096,
) -> DataFrame:
    """Stratified split: adds ``is_test``, exactly ``round(n_c * test_size)`` rows per class.

    Rows of a class are ordered by hash and the first ones are test rows. A
    class may hold a third of all rows, so it is never sorted as one group:
    counts per (class, hash slice) show the one slice each class is cut in,
    and only the keys of that slice are ranked. Then one scan compares every row
    with its class's threshold. ``key`` is unique; the number of classes is free.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    require_columns(df, [key, target])
    width = -(-HASH_RANGE // slices)
    hashed = df.withColumn("_h", row_hash(key, seed)).withColumn("_s", F.floor(F.col("_h") / width))

    per_slice = hashed.groupBy(target, "_s").agg(F.count("*").alias("_n"))
    by_class = Window.partitionBy(target)
    cut = (
        per_slice.withColumn("_quota", F.floor(F.sum("_n").over(by_class) * test_size + 0.5))
        .withColumn("_upto", F.sum("_n").over(by_class.orderBy("_s")))
        .withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_n")))
        .filter((F.col("_left") >= 0) & (F.col("_left") < F.col("_n")))
        .select(F.col(target).alias("_class"), F.col("_s").alias("_cut"), F.col("_left"))
    )
    cut = cut_lineage(cut)  # a row per class
    few = fits_broadcast(cut.count())
    side = F.broadcast(cut) if few else cut
    same = F.col(target).eqNullSafe(F.col("_class"))

    # The first row behind the cut is the threshold; only keys of the cut slices are ranked.
    border = hashed.select(target, "_h", "_s", key).join(side, same & (F.col("_s") == F.col("_cut")))
    ranked = border.withColumn("_r", F.row_number().over(Window.partitionBy(target, "_s").orderBy("_h", key)))
    first = ranked.filter(F.col("_r") == F.col("_left") + 1).select("_class", F.col("_h").alias("_first"), F.col(key).alias("_first_key"))
    joined = hashed.join(F.broadcast(first) if few else first, same, "left")
    ahead = (F.col("_h") < F.col("_first")) | ((F.col("_h") == F.col("_first")) & (F.col(key) < F.col("_first_key")))
    # A class whose rows are all test rows has no threshold.
    return joined.withColumn("is_test", F.coalesce(ahead, F.lit(True))).select(*df.columns, "is_test")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_period(
    ts: str = "incident_timestamp",
    start: str | None = None,
    end: str | None = None,
    year_column: str | None = None,
) -> Column:
    """Half-open range; with ``year_column`` also the partition predicate."""
    parts = []
    if start is not None:
        parts.append(F.col(ts) >= instant(start))
        if year_column:
            parts.append(F.col(year_column) >= int(start[:4]))
    if end is not None:
        parts.append(F.col(ts) < instant(end))
        if year_column:
            parts.append(F.col(year_column) <= int(end[:4]))
    condition = F.lit(True) if not parts else parts[0]
    for part in parts[1:]:
        condition = condition & part
    return condition


def frozen_test(
    df: DataFrame,
    test_start: str = "2014-01-01",
    ts: str = "incident_timestamp",
    year_column: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows before the boundary and rows from it on; neither may be empty."""
    require_columns(df, [ts])
    development = df.filter(in_period(ts, end=test_start, year_column=year_column))
    frozen = df.filter(in_period(ts, start=test_start, year_column=year_column))
    for name, part in (("development", development), ("frozen test", frozen)):
        if part.isEmpty():
            raise ValueError(f"the {name} period before/after {test_start} is empty")
    return development, frozen


@dataclass(frozen=True)
class Fold:
    """Train is everything before ``start``; validation is [start, end)."""

    fold: int
    start: str
    end: str

    def train(self, df: DataFrame, ts: str = "incident_timestamp", year_column: str | None = None) -> DataFrame:
        return df.filter(in_period(ts, end=self.start, year_column=year_column))

    def validation(self, df: DataFrame, ts: str = "incident_timestamp", year_column: str | None = None) -> DataFrame:
        return df.filter(in_period(ts, self.start, self.end, year_column))


def calendar_folds(years=(2011, 2012, 2013)) -> list[Fold]:
    return [Fold(i, f"{y}-01-01", f"{y + 1}-01-01") for i, y in enumerate(years, start=1)]


def _segments(folds: list[Fold], ts: str) -> tuple[Column, list[str]]:
    """Index of the stretch between fold boundaries a row falls in."""
    borders = sorted({b for f in folds for b in (f.start, f.end)})
    index = F.lit(0)
    for border in borders:
        index = index + (F.col(ts) >= instant(border)).cast("int")
    return index, borders


def _roles(folds: list[Fold], borders: list[str], segment: Column) -> Column:
    """The (fold, role) pairs a stretch belongs to, as an array."""
    place = {b: i + 1 for i, b in enumerate(borders)}  # first segment from this border on
    entries = []
    for f in folds:
        start, end = place[f.start], place[f.end]
        pair = lambda role: F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role"))
        entries.append(F.when(segment < start, pair("train")))
        entries.append(F.when((segment >= start) & (segment < end), pair("validation")))
    return F.array_compact(F.array(*entries))


def fold_classes(df: DataFrame, folds: list[Fold], ts: str = "incident_timestamp", target: str = "target") -> DataFrame:
    """Per fold, role and class: rows and first and last instant.

    The data is scanned once and aggregated by (stretch, class); the folds, which
    overlap, are assembled from those few rows.
    """
    segment, borders = _segments(folds, ts)
    stretches = df.groupBy(segment.alias("segment"), F.col(target).alias("target")).agg(
        F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    return (
        stretches.select("*", F.explode(_roles(folds, borders, F.col("segment"))).alias("use"))
        .groupBy("use.fold", "use.role", "target")
        .agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    )


def summarise_folds(df: DataFrame, folds: list[Fold], ts: str = "incident_timestamp", target: str = "target") -> DataFrame:
    """Dates, rows and class counts of every fold."""
    per_class = fold_classes(df, folds, ts, target).groupBy("fold", "target").agg(
        *[
            agg(F.when(F.col("role") == role, F.col(value))).alias(f"{role}_{value}")
            for role in ("train", "validation")
            for agg, value in ((F.sum, "rows"), (F.min, "first"), (F.max, "last"))
        ]
    )
    seen, checked = F.col("train_rows").isNotNull(), F.col("validation_rows").isNotNull()
    return per_class.groupBy("fold").agg(
        F.min("train_first").alias("train_start"),
        F.max("train_last").alias("train_end"),
        F.min("validation_first").alias("validation_start"),
        F.max("validation_last").alias("validation_end"),
        F.coalesce(F.sum("train_rows"), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("validation_rows"), F.lit(0)).alias("validation_rows"),
        F.count_if(seen).alias("train_classes"),
        F.count_if(checked).alias("validation_classes"),
        F.count_if(checked & ~seen).alias("unseen_validation_classes"),
    )


@dataclass
class FoldFacts:
    """What the planning of a cross-validation needs to know, read in one scan."""

    records: list[dict]
    classes: list  # of the development period
    all_classes: list  # of all rows
    train_classes: dict[int, list]
    frozen_rows: int


def fold_facts(
    df: DataFrame,
    folds: list[Fold],
    test_start: str | None = None,
    ts: str = "incident_timestamp",
    target: str = "target",
) -> FoldFacts:
    """Rows, dates and classes per fold; raises when a side of a fold, or a period, is empty.

    Rows from ``test_start`` on take no part. The data is aggregated by (stretch
    between boundaries, class); only those few rows come to the driver.
    """
    segment, borders = _segments(folds, ts)
    late = F.col(ts) >= instant(test_start) if test_start else F.lit(False)
    stretches = df.groupBy(late.alias("late"), segment.alias("segment"), F.col(target).alias("target")).agg(
        F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    found = bounded_rows(stretches, 2 * (len(borders) + 1) * MAX_CLASSES, "classes per stretch")
    early = [r for r in found if not r["late"]]
    if not early:
        raise ValueError("the development period is empty")
    frozen_rows = sum(r["rows"] for r in found if r["late"])
    if test_start and not frozen_rows:
        raise ValueError(f"the frozen test period from {test_start} on is empty")
    place = {b: i + 1 for i, b in enumerate(borders)}
    records, train_classes = [], {}
    for f in folds:
        sides = {
            "train": [r for r in early if r["segment"] < place[f.start]],
            "validation": [r for r in early if place[f.start] <= r["segment"] < place[f.end]],
        }
        record = asdict(f)
        for side, rows in sides.items():
            if not rows:
                raise ValueError(f"fold {f.fold} ({f.start} to {f.end}) has no {side} rows")
            record[f"{side}_rows"] = sum(r["rows"] for r in rows)
            record[f"{side}_start"] = min(r["first"] for r in rows)
            record[f"{side}_end"] = max(r["last"] for r in rows)
        train_classes[f.fold] = sorted({r["target"] for r in sides["train"]})
        records.append(record)
    every = sorted({r["target"] for r in found})
    return FoldFacts(records, sorted({r["target"] for r in early}), every, train_classes, frozen_rows)


def class_coverage(reference: DataFrame, comparison: DataFrame, target: str = "target") -> DataFrame:
    """One row: class counts of both sides, and the classes only one side has."""
    tagged = reference.select(F.col(target).alias("c"), F.lit(1).alias("r"), F.lit(0).alias("v")).unionByName(
        comparison.select(F.col(target).alias("c"), F.lit(0).alias("r"), F.lit(1).alias("v"))
    )
    # Both aggregations see at most one row per class and task.
    sides = tagged.groupBy("c").agg(F.max("r").alias("r"), F.max("v").alias("v"))

    def names(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("c"))))

    return sides.agg(
        F.sum("r").alias("reference_class_count"),
        F.sum("v").alias("comparison_class_count"),
        names((F.col("r") == 1) & (F.col("v") == 0)).alias("missing_from_comparison"),
        names((F.col("r") == 0) & (F.col("v") == 1)).alias("unseen_in_comparison"),
    )


def now_utc() -> datetime:
    from datetime import timezone

    return datetime.now(timezone.utc)
