"""Token counts of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import tokencount
from blotter.llm.common import table, text_or_empty
from blotter.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    counted = tokencount.count(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
