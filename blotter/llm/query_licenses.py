"""Licences of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import licenses
from blotter.llm.common import table
from blotter.llm.registry import query


def _sql() -> str:
    """Sentences as rows, joined to the catalogue; rules as one long chain of replacements."""
    gap = licenses.GAP
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.catalogue().items())
    # This engine's patterns look neither ahead nor back: ends of sentences get a mark of their own first.
    marked = r"regexp_replace(regexp_replace(t, '([.!?;])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), ':[ \t\r\f\v]*\n[ \t\n\r\f\v]*', ':' || chr(1), 'g')"
    chain, hits = "seq", []
    for name, run in licenses.rules():
        mark = f"'/{'//'.join(run)}/'"
        hits.append(f"CASE WHEN contains({chain}, {mark}) THEN '{name}' END")
        chain = f"l{len(hits)}"
    steps = "".join(
        f", c{i} AS (SELECT *, replace({'seq' if i == 1 else f'l{i - 1}'}, '/{'//'.join(run)}/', '/{gap}/') AS l{i} FROM c{i - 1})" for i, (_, run) in enumerate(licenses.rules(), 1)
    )
    last = len(hits)
    read = lambda name, pattern: (
        f"{name} AS (SELECT r, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (WHERE id <> '{gap}'), '') AS ids, count(*) FILTER (WHERE id <> '{gap}') AS n, '/' || string_agg(id, '//' ORDER BY pos) || '/' AS seq FROM ("
        f"SELECT r, pos, coalesce(k.id, '{gap}') AS id FROM (SELECT r, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT r, string_split_regex({marked}, '{pattern}') AS s FROM d)) "
        f"LEFT JOIN k ON k.s = regexp_replace(trim(regexp_replace(lower(line), '[^a-z0-9.]+', ' ', 'g')), '[. ]+$', '')) GROUP BY r)"
    )
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k(s, id) AS (VALUES {known}),
{read('a', r'\x01|[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*')},
{read('b', r'\x01')},
c0 AS MATERIALIZED (SELECT r, doc_id, CASE WHEN b.n > a.n THEN b.ids ELSE a.ids END AS license_sentences, CASE WHEN b.n > a.n THEN b.seq ELSE a.seq END AS seq FROM d JOIN a USING (r) JOIN b USING (r)){steps}
SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS licenses, license_sentences, CAST(len(list_filter(string_split(l{last}, '/'), lambda x: x <> '' AND x <> '{gap}')) AS BIGINT) AS unmatched
FROM (SELECT *, list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] IS NOT NULL AND NOT list_contains(h[1:i-1], h[i]) THEN h[i] END), lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT *, [{', '.join(hits)}] AS h FROM c{last}))"""


@query("op2_licenses", _sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.array_join("licences", ",").alias("licenses"), F.array_join("license_sentences", ",").alias("license_sentences"), "unmatched")
