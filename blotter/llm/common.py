"""Helpers shared by the corpus operators: table reading, row keys and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    """A column name that is safe in ``F.col``, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, prefixed until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for any column names, dots included; ``run`` goes by position."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    names = [f"c{i}" for i in range(len(schema.fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return plain.mapInArrow(renamed, kinds).toDF(*schema.names)


def stretches(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` that end behind a blank (0x20); a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut + 1
        yield data[at:end]
        at = end


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """Label every node of ``links`` (columns ``a``, ``b``, any orderable type) with its component's smallest node.

    Alternating large-star and small-star steps: each is one aggregation and one equi-join, edges never multiply
    and the number of rounds grows with the logarithm of the longest path. A hub is a hot join key only on the side
    that adaptive execution may split. State is checkpointed each round, so lost executors cost one round at most.
    No links give no rows; loops and repeated links are allowed. Returns ``node``, ``component``; nodes linked only
    to themselves are left out.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        # Large star: every neighbour above u goes to the smallest node around u.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every neighbour below u, and u itself, goes to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"Components did not settle in {rounds} rounds.")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
