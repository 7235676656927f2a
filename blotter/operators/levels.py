"""Sorted level tables of categorical columns: count, share and code per level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from blotter.session import BROADCAST_ROWS, bounded_rows, cut_lineage, fits_broadcast

MISSING = "UNKNOWN"
MAX_COLUMNS = 10_000
COUNTED_ROWS = 1 << 17  # rows whose levels a task counts at a time
INLINE_LEVELS = 64  # level tables up to this size become literals instead of joins
ROW_OFFSET = (1 << 33) - 1  # low bits of monotonically_increasing_id: row within partition


@dataclass
class Levels:
    """``table`` has feature, level, n, share and code; ``sizes`` rows and bytes per feature."""

    table: DataFrame
    sizes: dict[str, tuple[int, int]]
    _inline: dict | None = None

    def of(self, feature: str) -> DataFrame:
        return self.table.filter(F.col("feature") == feature)

    def count(self, feature: str) -> int:
        return self.sizes.get(feature, (0, 0))[0]

    def small(self, feature: str) -> bool:
        return fits_broadcast(*self.sizes.get(feature, (0, 0)))

    def inline(self) -> dict[str, list[tuple]]:
        """(level, code, share) of the features with very few levels, read once."""
        if self._inline is None:
            few = [f for f, (rows, _) in self.sizes.items() if rows <= INLINE_LEVELS]
            self._inline = {f: [] for f in few}
            if few:
                rows = self.table.filter(F.col("feature").isin(few)).select("feature", "level", "code", "share")
                for r in bounded_rows(rows, INLINE_LEVELS * len(few), "levels"):
                    self._inline[r["feature"]].append((r["level"], r["code"], r["share"]))
        return self._inline


def count_levels(df: DataFrame, columns, fill: str | None = MISSING) -> DataFrame:
    """Rows per (feature, level); all columns in one scan, combined before the shuffle."""
    text = "cast(`{c}` as string)" if fill is None else f"coalesce(cast(`{{c}}` as string), '{fill}')"
    names = list(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            for i, name in enumerate(names):
                found = table.column(i).combine_chunks().value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), found.field(0), found.field(1)], ["feature", "level", "n"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COUNTED_ROWS:
                yield from counted()
                held, rows = [], 0
        if held:
            yield from counted()

    read = df.select(*[F.expr(text.format(c=c)).alias(f"c{i}") for i, c in enumerate(names)])
    counts = read.mapInArrow(partial, "feature string, level string, n long")
    return counts.groupBy("feature", "level").agg(F.sum("n").alias("n"))


def level_sizes(counts: DataFrame) -> dict[str, tuple[int, int]]:
    stats = counts.groupBy("feature").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("level"), F.lit(0))).alias("bytes")
    )
    return {r["feature"]: (r["rows"], r["bytes"]) for r in bounded_rows(stats, MAX_COLUMNS, "columns")}


def with_codes(counts: DataFrame, sizes: dict[str, tuple[int, int]], per_task: int = BROADCAST_ROWS) -> DataFrame:
    """Number the levels 0, 1, 2, ... in sorted order within each feature.

    A feature with more than ``per_task`` levels is not numbered in one task:
    the levels are range-sorted, written, and numbered from their place within
    the partition plus the levels in the partitions before.
    """
    if max((rows for rows, _ in sizes.values()), default=0) <= per_task:
        order = Window.partitionBy("feature").orderBy(F.col("level").asc_nulls_last())
        return counts.withColumn("code", F.row_number().over(order) - 1)
    ordered = cut_lineage(counts.orderBy("feature", F.col("level").asc_nulls_last()))
    placed = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_OFFSET))
    )
    # A feature covers neighbouring partitions: at most features + partitions rows.
    starts = placed.groupBy("feature", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("feature").orderBy("_part")
    starts = starts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    joined = placed.join(F.broadcast(starts), ["feature", "_part"])
    return joined.withColumn("code", (F.col("_before") + F.col("_row") - F.col("_first")).cast("int")).drop(
        "_part", "_row", "_before", "_first"
    )


def fit_levels(df: DataFrame, columns, fill: str | None = MISSING, per_task: int = BROADCAST_ROWS) -> Levels:
    """Count, check and number the levels; the result is written to the shared folder once."""
    columns = list(columns)
    counts = cut_lineage(count_levels(df, columns, fill))
    sizes = level_sizes(counts)
    total = Window.partitionBy("feature")
    if max((rows for rows, _ in sizes.values()), default=0) <= per_task:
        shared = counts.withColumn("share", F.col("n") / F.sum("n").over(total))
    else:
        # Every feature has one level per row, so all totals equal the row count.
        rows = counts.filter(F.col("feature") == columns[0]).agg(F.sum("n")).first()[0]
        shared = counts.withColumn("share", F.col("n") / F.lit(rows))
    return Levels(with_codes(shared, sizes, per_task), sizes)
