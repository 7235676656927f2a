"""The nearest vectors of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import crosspolytope
from blotter.llm.common import table
from blotter.llm.registry import query


@query("op4_cross_polytope")
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
