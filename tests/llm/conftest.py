import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, repeated rows, equal identifiers and clashing columns."""
    long = " ".join(f"word{i % 977} of a long text." for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One short line."), (4, "One short line."), (4, "Another text under the same identifier."),
        (None, "A text without an identifier."), (None, None), (5, long), (6, long), (7, "12345 !!! ---"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["_d", "_h", "_t", "_row", "lead", "span", "fp", "score", "lang_pred", "token_ids", "decoded", "spans", "kept", "removed", "licences", "a.b"]
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(c).alias(c) for c in clash))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
