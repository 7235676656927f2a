"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only when a count has shown it to stay below these bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024

# The JVM interprets methods of more bytes for good; stages with one are better run operator by operator.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app_name: str = "blotter", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators rely on; ``settings`` win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT[0]: METHOD_LIMIT[1],
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def compiled_methods(spark: SparkSession) -> SparkSession:
    """The session, with the bound on generated methods that ``build_session`` sets, unless it has one below Spark's own."""
    name, limit = METHOD_LIMIT
    if int(spark.conf.get(name)) > int(limit):
        spark.conf.set(name, limit)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
    own = tempfile.mkdtemp(prefix="blotter-")
    context.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back without its history."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def cached(df: DataFrame):
    """Keep ``df`` for the passes of a fit; lost blocks are recomputed from their source.

    A frame the caller has persisted already is left alone.
    """
    mine = df.storageLevel == StorageLevel.NONE
    if mine:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        if mine:
            df.unpersist()


def fits_broadcast(rows: int, text_bytes: int = 0, row_bytes: int = 32) -> bool:
    """Whether a counted table is small enough to be sent to every executor."""
    return rows <= BROADCAST_ROWS and text_bytes + rows * row_bytes <= BROADCAST_BYTES


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result whose size is bounded by ``limit``; refuse a larger one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
