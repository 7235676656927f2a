"""The language of every document, learned from the documents that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blotter.llm import langid
from blotter.llm.common import table
from blotter.llm.registry import query


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.drop("lang"), langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")
