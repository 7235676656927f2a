"""Write all pages to WARC archives and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import warc
from blotter.llm.common import table
from blotter.llm.registry import query
from blotter.session import scratch_path

# Twenty bits of the digest are five hexadecimal digits or four letters.
SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS keeper FROM p)
SELECT page_id, payload_bytes,
 list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
 CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM d"""


@query("op1_warc", SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    number = lambda c: F.col(c).cast("long").alias(c)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
