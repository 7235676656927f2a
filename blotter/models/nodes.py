"""The node table of tree models: one row per node, for saving, scoring and importances.

``round`` counts rounds or trees, ``class`` is the class a tree adds to (-1: to all). An inner node sends rows with a value of
at most ``threshold`` in ``feature`` to ``left`` and the others, missing values included, to ``right``; a leaf has feature -1.
``value`` holds what a row gets there, ``gain`` what the split won, ``cover`` the weight of its training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from blotter.models.binned import as_array
from blotter.session import cut_lineage

SCHEMA = "round int, class int, node long, feature int, threshold double, left long, right long, gain double, cover double, value array<double>"
#: Bytes of node arrays that are sent to every executor; larger models are scored by joins.
SENT_BYTES = 256 << 20
#: Bytes of the node arrays of the trees that meet a slice of rows in one group, and of the features of such a slice.
SHARD_BYTES, SLICE_BYTES = 32 << 20, 32 << 20
#: Cells a walk handles at once.
CELLS = 1 << 20


class Walker:
    """Trees as flat arrays; rows walk all of them at once."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("round", "ascending"), ("class", "ascending"), ("node", "ascending")]).combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        tree = np.stack([column("round"), column("class")])
        first = np.flatnonzero(np.concatenate([[True], (tree[:, 1:] != tree[:, :-1]).any(axis=0)])) if table.num_rows else np.empty(0, int)
        self.roots, self.classes = first, column("class")[first]
        self.feature, self.threshold = column("feature").astype(np.int32), column("threshold")
        # Identifiers of children become places.
        self.child = np.zeros((2, table.num_rows), np.int32)
        for start, end in zip(first, np.append(first[1:], table.num_rows)):
            own = column("node")[start:end]
            for side, name in enumerate(("left", "right")):
                self.child[side, start:end] = start + np.minimum(np.searchsorted(own, column(name)[start:end]), end - start - 1)
        # Values are kept for leaves only; inner nodes may have none.
        leaf = self.feature < 0
        values = pa.chunked_array(table.column("value")).filter(pa.array(leaf)).combine_chunks()
        count = int(leaf.sum())
        self.value = values.flatten().to_numpy().astype(np.float64).reshape(count, -1) if count else np.zeros((0, 1))
        self.child[0, leaf] = np.arange(count)

    @property
    def bytes(self) -> int:
        return self.feature.nbytes + self.threshold.nbytes + self.child.nbytes + self.value.nbytes

    def leaves(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """Number of the leaf of each tree and row; ``x`` is feature-major."""
        at = np.repeat(roots[:, None], x.shape[1], axis=1)
        rows = np.arange(x.shape[1])
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.child[0, at]
            right = ~(x[np.maximum(feature, 0), rows] <= self.threshold[at])
            at = np.where(inner, self.child[right.astype(np.int8), at], at)

    def sums(self, x: np.ndarray, classes: int) -> np.ndarray:
        """Sum of the trees' values per class and row."""
        out = np.zeros((classes, x.shape[1]))
        step = max(1, CELLS // max(1, x.shape[1]))
        for at in range(0, len(self.roots), step):
            found = self.leaves(x, self.roots[at : at + step])
            for k, leaf in zip(self.classes[at : at + step], found):
                if k < 0:
                    out += self.value[leaf].T
                else:
                    out[k] += self.value[leaf, 0]
        return out


def summed(spark: SparkSession, walker: Walker, classes: int, features: Column) -> Column:
    """The trees' sums as ``array<double>``, in one expression over a feature array."""
    shared = spark.sparkContext.broadcast(walker)

    @arrow_udf("array<double>")
    def walk(x: pa.Array) -> pa.Array:
        return _walked(shared.value, x, classes)

    return walk(features)


def _walked(walker: Walker, x: pa.Array, classes: int) -> pa.Array:
    rows, parts = len(x), []
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1).T if rows else np.empty((0, 0))
    for at in range(0, rows, 4096):
        parts.append(walker.sums(np.ascontiguousarray(flat[:, at : at + 4096]), classes).T)
    sums = np.concatenate(parts) if parts else np.empty((0, classes))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * classes, pa.int32()), pa.array(sums.ravel()))


def _keyed(df: DataFrame, features: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with a key of its contents, and the features of each key."""
    rows = df.withColumn(key, F.struct(F.xxhash64(*df.columns), F.hash(*df.columns)))
    return rows, rows.select(key, as_array(df, features).alias("x")).dropDuplicates([key])


def summed_by_shards(df: DataFrame, nodes: DataFrame, classes: int, features: str, name: str) -> DataFrame:
    """``df`` with the trees' sums in ``name``, for models too large to be sent whole.

    Trees are dealt to shards and rows to slices, and each shard walks each slice once. A model with a tree too large to be
    sent is scored by joins.
    """
    key, leaves = "_row", F.sum(F.expr("int(feature < 0)"))
    # One short row per tree.
    trees = nodes.groupBy("round", "class").agg(F.count("*").alias("n"), leaves.alias("leaves"), F.max("feature").alias("last")).orderBy("round", "class").collect()
    sizes = [24 * t["n"] + 8 * (classes if t["class"] < 0 else 1) * t["leaves"] for t in trees]
    if max(sizes, default=0) > SENT_BYTES:
        return summed_by_join(df, nodes, classes, features, name)
    dealt, shard, held = [], 0, 0
    for tree, size in zip(trees, sizes):
        if held and held + size > SHARD_BYTES:
            shard, held = shard + 1, 0
        dealt.append((tree["round"], tree["class"], shard))
        held += size
    rows, x = _keyed(df, features, key)
    values, width = x.agg(F.sum(F.size("x")), F.max(F.size("x"))).first()
    slices = max(1, -(-8 * (values or 0) // SLICE_BYTES))
    # Rows without features go right everywhere.
    missing = F.array_repeat(F.lit(float("nan")), max([width or 0, *(t["last"] + 1 for t in trees)]))
    shards = F.broadcast(df.sparkSession.createDataFrame(dealt, "round int, class int, shard int"))
    own = nodes.select("round", "class", "node", "feature", "threshold", "left", "right", F.expr("if(feature < 0, value, array())").alias("value"))
    own = own.join(shards, ["round", "class"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = x.withColumn("slice", F.pmod(F.col(f"{key}.col1"), F.lit(slices)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard))))
    met = met.select(F.col(f"{key}.col1").alias("a"), F.col(f"{key}.col2").alias("b"), F.coalesce("x", missing).alias("x"), "shard", "slice")

    def walk(nodes_: pa.Table, rows_: pa.Table) -> pa.Table:
        rows_ = rows_.combine_chunks()
        if not rows_.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "sums": pa.array([], pa.list_(pa.float64()))})
        flat = pa.chunked_array(rows_.column("x")).combine_chunks()
        return pa.Table.from_arrays([rows_.column("a"), rows_.column("b"), _walked(Walker(nodes_), flat, classes)], ["a", "b", "sums"])

    parts = own.groupBy("shard", "slice").cogroup(met.groupBy("shard", "slice")).applyInArrow(walk, "a long, b int, sums array<double>")
    sums = parts.groupBy("a", "b").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(classes)]).alias(name))
    sums = sums.select(F.struct(F.col("a").alias("col1"), F.col("b").alias("col2")).alias(key), name)
    return rows.join(sums, key).drop(key)


def summed_by_join(df: DataFrame, nodes: DataFrame, classes: int, features: str, name: str) -> DataFrame:
    """``df`` with the trees' sums in ``name``, for models too large to be sent: every level is an equi-join on (tree, node)."""
    key = "_row"
    rows, x = _keyed(df, features, key)
    trees = nodes.groupBy("round", "class").agg(F.min("node").alias("node"))
    slices = F.explode(F.sequence(F.lit(0), F.lit(31)))
    # Trees meet rows through slices of the rows' hash: an equi-join, no product of whole tables in one task.
    at = x.withColumn("slice", F.pmod(F.col(f"{key}.col1"), F.lit(32)).cast("int")).join(trees.withColumn("slice", slices), "slice").drop("slice")
    deepest = nodes.agg(F.countDistinct("node")).first()[0]
    done = None
    for _ in range(deepest):
        met = at.join(nodes.select("round", "class", "node", "feature", "threshold", "left", "right", "value"), ["round", "class", "node"])
        met = cut_lineage(met)
        ended = met.filter("feature < 0").select(key, "class", "value")
        done = ended if done is None else done.unionByName(ended)
        at = met.filter("feature >= 0").withColumn("node", F.expr("if(x[feature] <= threshold, left, right)")).select(key, "x", "round", "class", "node")
        if at.isEmpty():
            break
    cells = [F.sum(F.when(F.col("class") == k, F.col("value")[0]).when(F.col("class") < 0, F.get("value", F.lit(k)))) for k in range(classes)]
    sums = done.groupBy(key).agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in cells]).alias(name))
    return rows.join(sums, key).drop(key)
