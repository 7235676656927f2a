"""Repeated sentence spans of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import spans
from blotter.llm.common import table
from blotter.llm.registry import query


@query("op6_sentence_spans")
def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_sentences", "n_removed", F.size("removed").cast("long").alias("n_spans"), "removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
