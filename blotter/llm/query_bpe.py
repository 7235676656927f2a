"""Token counts and digests of every document, and of what its tokens decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import bpe
from blotter.llm.common import table
from blotter.llm.registry import query

VOCABULARY = "byte_bpe_50k.tiktoken"


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of identifiers and decoded bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "text"), path, pattern or public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
