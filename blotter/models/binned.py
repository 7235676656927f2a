"""Training rows in blocks of columns, and the numbers that tree growth draws from their hashes.

Features are binned once: columns with few distinct values get a bin per value, the others quantile bins. Rows then travel as blocks, one matrix of bin numbers (or of values) per block, so a pass over the data is one
job that hands whole matrices to numpy. NaN and null are larger than every value: they go to the last bin, and right.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.operators.quantiles import FEW_VALUES, counted_profile, known, order_statistics, profile, value_counts
from blotter.session import cached, scratch_path

MAX_BINS = 256
BLOCK_ROWS, TASK_ROWS = 16_384, 8_192
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # multipliers of the splitmix64 finaliser (fixed values)
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from any 64-bit numbers."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def keyed(x: np.ndarray, *keys: int) -> np.ndarray:
    """``x`` mixed with some numbers in turn."""
    x = mixed(x)
    for key in keys:
        x = mixed(x ^ np.uint64((key * GOLDEN + 1) & MASK))
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Mixed numbers as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def as_array(df: DataFrame, column: str):
    return vector_to_array(F.col(column)) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column)


def learn_edges(df: DataFrame, column: str, width: int, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, at most ``bins`` - 1; the last bin has none.

    Few different values get a bin each. Otherwise edges are exact quantiles, and from ``FEW_VALUES`` different values on
    those of a sketch, which may differ a little between partitionings.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between 2 and {MAX_BINS}")
    names = [f"f{i}" for i in range(width)]
    array = as_array(df, column)
    rows = df.select(array.alias("x")).select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    with ExitStack() as held:
        rows, counts = held.enter_context(cached(rows)), None
        if (size := rows.count()) <= FEW_VALUES:
            # One pass counts the values of all columns, the rest is read off the counts.
            counts = held.enter_context(cached(value_counts(rows, names)))
        stats = profile(rows, names) if counts is None else counted_profile(counts, names, size)
        found: dict[str, list[float]] = {}
        few = [n for n in names if stats[n]["distinct"] <= 0.9 * bins]
        if few:
            # A set is only collected where its size was estimated first; it stays near ``bins`` values.
            if counts is None:
                sets = rows.agg(*[F.expr(f"array_sort(collect_set({known(n)}))").alias(n) for n in few]).first()
            else:
                listed = counts.filter(F.col("feature").isin(few)).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("values")).collect()
                sets = {n: [] for n in few} | {r["feature"]: r["values"] for r in listed}
            for n in few:
                values = np.array(sets[n], np.float64)
                found[n] = values[:-1] if len(values) <= bins else values[np.linspace(0, len(values) - 1, bins + 1).astype(int)[1:-1]]
        some = {n: stats[n]["n"] for n in names if n not in few and stats[n]["distinct"] <= FEW_VALUES}
        places = {n: [max(0, -(-m * i // bins) - 1) for i in range(1, bins)] for n, m in some.items()}
        values = order_statistics(rows, {n: set(p) for n, p in places.items()}, stats, counts=counts) if places else {}
        found.update({n: np.array([values[n, k] for k in p]) for n, p in places.items()})
        many = [n for n in names if n not in found]
        if many:
            steps = "array(" + ", ".join(f"double({i / bins!r})" for i in range(1, bins)) + ")"
            sketched = rows.agg(*[F.expr(f"percentile_approx({known(n)}, {steps}, {20 * bins})").alias(n) for n in many]).first()
            found.update({n: np.array(sketched[n]) for n in many})
    return [np.unique(np.asarray(found[n], np.float64)) for n in names]


def blocks(df: DataFrame, features: str, label: str, key, edges: list[np.ndarray] | None, rows: int, classes: int = 0, kind=np.uint8) -> DataFrame:
    """``df`` as blocks, written to shared storage: ``n``, ``x``, ``label``, ``hash`` and ``margin`` (zeros for ``classes``).

    ``x`` is feature-major, bin numbers of a ``kind``, or doubles without ``edges``. ``key`` identifies a row: whatever is drawn
    for a row depends on it alone, not on where the row lies.
    """
    spark = df.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, rows // TASK_ROWS))
    size = min(BLOCK_ROWS, rows // (2 * tasks) + 1)
    plain = df.select(as_array(df, features).alias("x"), F.col(label).cast("int").alias("label"), key.alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = pa.chunked_array(table.column("x")).combine_chunks().flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1).T
            if edges is None:
                x = np.ascontiguousarray(x)
            else:
                x = np.stack([np.searchsorted(e, v, "left").astype(kind) for e, v in zip(edges, x)])
            cells = [x.tobytes(), table.column("label").to_numpy().astype(np.int32).tobytes(), table.column("hash").to_numpy().tobytes(), bytes(8 * n * classes)]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["n", "x", "label", "hash", "margin"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield flush()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield flush()

    path = scratch_path(spark, "blocks")
    plain.mapInArrow(run, "n int, x binary, label binary, hash binary, margin binary").repartition(tasks).write.parquet(path)
    return fixed_session(spark).read.parquet(path)


def fixed_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` without adaptive planning: growth runs thousands of small jobs of one fixed shape."""
    beside = spark.newSession()
    beside.conf.set("spark.sql.adaptive.enabled", "false")
    beside.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return beside


class Block:
    """One block as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, kind=np.uint8):
        cell = lambda j, t: np.frombuffer(batch.column(j)[i].as_buffer(), t)
        self.n = batch.column(0)[i].as_py()
        self.x = cell(1, kind).reshape(-1, self.n)
        self.label, self.hash = cell(2, np.int32), cell(3, np.int64).view(np.uint64)
        self.margin = cell(4, np.float64).reshape(-1, self.n)


def each(batches: Iterator[pa.RecordBatch], kind=np.uint8) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i, kind)
