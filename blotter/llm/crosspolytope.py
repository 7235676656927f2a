"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length (inner products of vectors of unequal length are turned into angles by one more
coordinate) and padded to a power of two. A table rotates them with three rounds of random signs and a fast Hadamard
transform; the nearest signed axis is the bucket. With ``depth`` rotations per table a bucket is a tuple of axes; tables
and probes grow with it until the computed chance of meeting a neighbour is ``CHANCE``. Every
vector is indexed once in each table, a query probes several buckets per table, those whose axes lie nearest, and all
vectors met are ranked by their exact inner product in double precision.

Equal vectors are searched and indexed once: of a group of copies the ``k`` + 1 smallest identifiers can be among the
neighbours, and every copy that is a query gets the group's answer without itself. A bucket is dealt out in blocks, vectors
against queries, by counted sizes, so no task holds a whole bucket; each block keeps a query's best ``k`` + 1 groups.

Vectors that are null, zero, hold a null or non-finite component, or have another length than most take no part. Repeated
rows (same identifier and vector) count once. Ties go to the smaller identifier. No vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import quoted
from blotter.session import cut_lineage

TABLES = 8
PROBES = 8
#: Distinct vectors a bucket should hold on average at least; depth follows from it.
BUCKET = 256
#: Candidates a query should meet at least; small tables are probed more widely for it.
CANDIDATES = 10_000
#: Chance at least of meeting the k-th nearest of as many random vectors, and the pairs it is computed from.
CHANCE, PAIRS = 0.92, 500
#: Most tables to choose from, and how many probes a further table weighs (its index holds every vector).
MOST_TABLES, TABLE_WEIGHT = 64, 20
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
SEED = 11


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of every row; the width is a power of two."""
    count, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(count, -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(count, width)
        step *= 2
    return rows / math.sqrt(width)


def rotate(rows: np.ndarray, table: int, depth: int) -> np.ndarray:
    """The pseudo-rotation of one table and depth: signs and transform, three times."""
    draw = np.random.default_rng([SEED, table, depth])
    for _ in range(3):
        rows = hadamard(rows * draw.choice([-1.0, 1.0], rows.shape[1]))
    return rows


def unit(rows: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Unit vectors whose angles order like inner products; ``longest`` is 0 if all lengths agree."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    if longest and not query:
        rows = np.hstack([rows / longest, np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))])
    else:
        rows = rows / length
        rows = np.hstack([rows, np.zeros_like(length)]) if longest else rows
    width = 1 << (rows.shape[1] - 1).bit_length()
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def signed_axes(rotated: np.ndarray) -> np.ndarray:
    """Scores of the signed axes: axis a at 2a, its opposite at 2a + 1."""
    return np.stack([rotated, -rotated], 2).reshape(len(rotated), -1)


def buckets(rows: np.ndarray, table: int, depth: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every unit vector in one table, nearest first."""
    step = max(1, (1 << 22) // (2 * rows.shape[1] * probes))
    if len(rows) > step:  # joint scores in bounded room
        return np.vstack([buckets(rows[at : at + step], table, depth, probes) for at in range(0, len(rows), step)])
    best = np.zeros((len(rows), 1))
    code = np.zeros((len(rows), 1), np.int64)
    for level in range(depth):
        scores = signed_axes(rotate(rows, table, level))
        few = min(probes, scores.shape[1])
        top = np.argpartition(-scores, few - 1, 1)[:, :few]
        value = np.take_along_axis(scores, top, 1)
        joint = (best[:, :, None] + value[:, None, :]).reshape(len(rows), -1)
        codes = (code[:, :, None] * scores.shape[1] + top[:, None, :]).reshape(len(rows), -1)
        order = np.argpartition(-joint, min(probes, joint.shape[1]) - 1, 1)[:, :probes]
        order = np.take_along_axis(order, np.argsort(-np.take_along_axis(joint, order, 1), 1, kind="stable"), 1)
        best, code = np.take_along_axis(joint, order, 1), np.take_along_axis(codes, order, 1)
    return code


def _groups(vectors: DataFrame, vec_id: str, embedding: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Members (``g1``, ``g2``, ``id``) and one row per distinct vector with its ``k`` + 1 smallest identifiers."""
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("id"), F.col(quoted(embedding)).alias("v"))
    if rows.schema["v"].dataType.elementType.typeName() != "float":  # floats are carried as they are, for half the bytes
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (usual["n"] if usual else 0))
    keyed = rows.select("id", "v", F.xxhash64("v").alias("g1"), F.xxhash64("v", F.lit(1)).alias("g2"))
    members = cut_lineage(keyed.select("g1", "g2", "id").distinct())
    # Only the first identifiers of a group leave the map side.
    nearest = Window.partitionBy("g1", "g2").orderBy("id")
    first = members.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).groupBy("g1", "g2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    shown = keyed.groupBy("g1", "g2").agg(F.first("v").alias("v"))
    return members, first.join(shown, ["g1", "g2"])


def near_cosine(vectors: int, size: int, k: int) -> float:
    """The cosine at which the ``k``-th nearest of so many random directions in ``size`` coordinates lies."""
    angle = np.linspace(0, np.pi, 100_001)
    mass = np.cumsum(np.sin(angle) ** max(0, size - 2))
    return float(np.cos(angle[np.searchsorted(mass, mass[-1] * min(1.0, k / max(1, vectors)))]))


@lru_cache(64)
def bucket_ranks(size: int, width: int, depth: int, cosine: float) -> np.ndarray:
    """Sorted: how far out in a query's order of buckets the one of a vector at ``cosine`` lies, for random pairs."""
    draw = np.random.default_rng([SEED, size, depth])
    query, other = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in draw.normal(size=(2, PAIRS, size)))
    other = other - (other * query).sum(1, keepdims=True) * query
    other = cosine * query + math.sqrt(max(0.0, 1 - cosine**2)) * other / np.maximum(1e-12, np.linalg.norm(other, axis=1, keepdims=True))
    query, other = (np.pad(x, ((0, 0), (0, width - size))) for x in (query, other))
    scores = [signed_axes(rotate(query, 0, level)) for level in range(depth)]
    axes = [signed_axes(rotate(other, 0, level)).argmax(1) for level in range(depth)]
    ranks = np.empty(PAIRS, np.int64)
    for i in range(PAIRS):
        own, sums = sum(s[i, a[i]] for s, a in zip(scores, axes)), np.zeros(1)
        for s in scores[:-1]:
            sums = (sums[:, None] + s[i]).ravel()
        last = np.sort(scores[-1][i])
        ranks[i] = 1 + (len(last) - np.searchsorted(last, own - sums + 1e-12, "right")).sum()
    return np.sort(ranks)


def plan(vectors: int, width: int, tables: int = TABLES, probes: int = PROBES, k: int = 20, size: int | None = None, shrink: float = 1.0, depth: int | None = None) -> tuple[int, int, int]:
    """Depth, tables and probes per table.

    Depth grows with the logarithm of the vectors. Tables (from ``tables`` on, doubled) and probes are the cheapest with
    which the ``k``-th nearest of random vectors of ``size`` coordinates is met with ``CHANCE``; ``shrink`` is what unequal
    lengths leave of a cosine. Small tables are probed until enough vectors are met.
    """
    axes = 2 * width
    depth = depth or max(1, int(math.log(max(1, vectors / BUCKET), axes)))
    ranks = bucket_ranks(size or width, width, depth, round(shrink * near_cosine(vectors, size or width, k), 3))
    choices = []
    for count in [tables] + [t for t in (tables << i for i in range(1, 20)) if t <= MOST_TABLES]:
        each = 1 - (1 - CHANCE) ** (1 / count)
        choices.append((count, max(probes * depth * depth if count == tables else probes, int(ranks[math.ceil(each * len(ranks)) - 1]))))
    tables, probes = min(choices, key=lambda c: c[0] * (c[1] + TABLE_WEIGHT))
    wanted = math.ceil(CANDIDATES * axes**depth / (max(1, vectors) * tables))
    return depth, tables, min(axes**depth, max(probes, wanted))


def _indexed(rows: DataFrame, tables: int, depth: int, probes: int, longest: float, query: bool) -> DataFrame:
    """Every distinct vector with the buckets it lies in, or probes, in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(1024, 65_536 // probes))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = np.stack([np.asarray(x.values) for x in batch.column("v")]).astype(float)
                flat = unit(v, longest, query)
                for t in range(tables):
                    codes = buckets(flat, t, depth, probes)
                    take = pa.array(np.repeat(np.arange(len(v)), codes.shape[1]))
                    part = batch.take(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), t, np.int32)), pa.array(codes.ravel()), *part.columns], ["t", "bucket", *batch.schema.names])

    return rows.mapInArrow(run, "t int, bucket long, " + ", ".join(f"{n} {k}" for n, k in rows.dtypes))


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, probes: int = PROBES, depth: int | None = None) -> DataFrame:
    """The ``k`` nearest vectors found for every row for which ``queries`` holds (an expression over ``vec_id``).

    ``tables`` and ``probes`` are the least to use. Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``.
    """
    members, groups = _groups(vectors, vec_id, embedding, k)
    groups = cut_lineage(groups)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = groups.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.min(length).alias("low"), F.max(length).alias("high"), F.avg(length).alias("mean")).first()
    longest = facts["high"] if facts["n"] and facts["high"] - facts["low"] > 1e-3 * facts["high"] else 0.0
    size = max(1, (facts["width"] or 1) + (longest > 0))
    width = 1 << (size - 1).bit_length()
    depth, tables, probes = plan(facts["n"], width, tables, probes, k, size, facts["mean"] / longest if longest else 1.0, depth)
    asked = members.filter(queries).select("g1", "g2", F.col("id").alias("query_id"))
    wanted = asked.select("g1", "g2").distinct().join(groups.select("g1", "g2", "v"), ["g1", "g2"])
    index = _indexed(groups, tables, depth, 1, longest, False)
    probe = _indexed(wanted, tables, depth, probes, longest, True)

    # Blocks by counted bucket sizes.
    sizes = index.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("across"))
    loads = probe.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("down"))
    grid = cut_lineage(sizes.join(loads, ["t", "bucket"]))
    spread = lambda n: F.pmod(F.xxhash64("g1", "g2", "t"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["t", "bucket", "x", "y"]
    left = index.join(grid, ["t", "bucket"]).withColumn("x", spread("across")).withColumn("y", every("down"))
    right = probe.join(grid, ["t", "bucket"]).withColumn("y", spread("down")).withColumn("x", every("across"))

    def block(key, seek: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(seek) or not len(held):
            return pd.DataFrame({"g1": [], "g2": [], "score": [], "ids": []})
        a, b = np.stack(seek["v"].to_numpy()).astype(float), np.stack(held["v"].to_numpy()).astype(float)
        rough = a @ b.T
        few = min(k + 1, len(b))
        least = -np.partition(-rough, few - 1, 1)[:, few - 1]
        row, column = np.nonzero(rough >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
        # The score of a pair is summed the same way wherever the pair meets.
        score = np.einsum("ij,ij->i", a[row], b[column])
        return pd.DataFrame({"g1": seek["g1"].to_numpy()[row], "g2": seek["g2"].to_numpy()[row], "score": score, "ids": held["ids"].to_numpy()[column]})

    met = right.select(*cell, "g1", "g2", "v").groupBy(*cell).cogroup(left.select(*cell, "v", "ids").groupBy(*cell))
    found = met.applyInPandas(block, "g1 long, g2 long, score double, ids array<long>")
    # A vector met in several tables counts once; its smallest identifier names it.
    own = Window.partitionBy("g1", "g2").orderBy(F.desc("score"), F.col("ids")[0])
    best = found.groupBy("g1", "g2", F.col("ids")[0].alias("h")).agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = best.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= k + 1)
    answer = best.groupBy("g1", "g2").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["minus"].alias("minus"), i.alias("id")))))
    answer = answer.select("g1", "g2", F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    joined = asked.join(answer, ["g1", "g2"]).select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    rows = joined.select("query_id", F.posexplode("near").alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
