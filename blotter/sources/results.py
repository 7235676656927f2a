"""Experiment results and dashboard tables as files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from blotter.operators.splits import now_utc
from blotter.plans.config import ExperimentConfig


def new_run_id(config: ExperimentConfig, when=None) -> str:
    """Name and UTC second; the suffix keeps runs of the same second apart."""
    stamp = (when or now_utc()).strftime("%Y%m%dT%H%M%SZ")
    return f"{config.experiment_name}__{stamp}_{uuid.uuid4().hex[:6]}"


def save_run(
    folder: str,
    config: ExperimentConfig,
    folds: DataFrame,
    summary: DataFrame,
    run_id: str | None = None,
    extra: dict | None = None,
) -> str:
    """Write the fold rows, the summary rows and the metadata of one run."""
    run_id = run_id or new_run_id(config)
    places = {kind: f"{folder}/{kind}/run_id={run_id}" for kind in ("folds", "summaries", "metadata")}
    folds.coalesce(1).write.mode("overwrite").parquet(places["folds"])
    summary.coalesce(1).write.mode("overwrite").parquet(places["summaries"])
    record = {
        "run_id": run_id,
        "created_at_utc": now_utc().isoformat(),
        "configuration": config.to_dict(),
        "fold_results": places["folds"],
        "summary_results": places["summaries"],
        **(extra or {}),
    }
    row = folds.sparkSession.range(1).select(F.lit(json.dumps(record, default=str)).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(places["metadata"])
    return run_id


def read_runs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All runs of a kind, columns matched by name, absent ones null; ``run_id`` first."""
    rows = (
        spark.read.option("mergeSchema", True)
        .option("basePath", f"{folder}/{kind}")
        .parquet(f"{folder}/{kind}/run_id=*")
    )
    rows = rows.withColumn("run_id", F.col("run_id").cast("string"))
    return rows.select("run_id", *[c for c in rows.columns if c != "run_id"])


def stack_runs(frames: list[DataFrame]) -> DataFrame:
    """Run tables of different widths stacked by column name."""
    if not frames:
        raise ValueError("no run tables")
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def rebuild_master(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Stack all saved runs and replace the two master tables."""
    masters = []
    for kind, name in (("folds", "experiment_fold_results"), ("summaries", "experiment_summary_results")):
        rows = read_runs(spark, folder, kind)
        export_table(rows, f"{folder}/dashboard/{name}")
        masters.append(rows)
    return masters[0], masters[1]


#: Tables up to so many rows are exported as one file.
ONE_FILE_ROWS = 1_000_000


def export_table(df: DataFrame, path: str, single: bool | None = None) -> None:
    """CSV with header; one file unless the table is too long for one task (None: that is counted)."""
    if single is None:
        single = df.limit(ONE_FILE_ROWS + 1).count() <= ONE_FILE_ROWS
    frame = df.coalesce(1) if single else df
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_all(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    places = {}
    for name, table in tables.items():
        places[name] = f"{folder}/{name}"
        export_table(table, places[name])
    return places
