"""Repeated substrings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import substrings
from blotter.llm.common import table
from blotter.llm.registry import query


def digest(docs: DataFrame, **options) -> DataFrame:
    found = substrings.dedup(docs, keep=["doc_id"], **options)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_induced_sorting")
def op7_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
