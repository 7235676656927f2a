"""Documents that hold benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import decontaminate
from blotter.llm.common import table
from blotter.llm.registry import query


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.col("leak.edits").cast("long").alias("edits"), F.col("leak.end").cast("long").alias("match_end"))
