"""The documents that match each benchmark item best."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blotter.llm import lexical
from blotter.llm.common import table
from blotter.llm.registry import query

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS t FROM documents),
held AS (SELECT d, doc_id, len(t) AS n, t FROM docs WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM held),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
m AS (SELECT d, doc_id, 75 + ((25 * n * nn) // ll) AS m FROM held, total),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(t) AS term FROM (SELECT item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, d, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_lexical_search", SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
