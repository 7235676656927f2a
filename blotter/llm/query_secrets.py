"""Secrets of every document: counts, a digest of the base spans, and all spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import secrets
from blotter.llm.common import table
from blotter.llm.registry import query


def digest(docs: DataFrame, **options) -> DataFrame:
    found = secrets.spans(docs, keep=["doc_id"], **options)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(secrets.KINDS) if not k.weak),
        F.sha2(secrets.as_text(F.filter("spans", lambda s: s["kind"] < secrets.BASE)), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def _class(letter: str) -> str:
    return f"[{letter.upper()}{letter}]" if letter.isalpha() else letter


def _sql_pattern(pattern: str) -> str:
    """The pattern for an engine whose case folding goes beyond ASCII: keywords are spelt out in both cases."""
    if not pattern.startswith("(?i)"):
        return pattern.replace("'", "''")
    out, inside, skip = "", 0, 0
    for i, c in enumerate(pattern[4:], 4):
        if skip:
            skip -= 1
            out += c
        elif c == "\\":
            skip = 3 if pattern[i + 1] == "x" else 1
            out += c
        else:
            inside += (c == "[") - (c == "]")
            out += c if inside or c == "]" else _class(c)
    return out.replace("'", "''")


def _sql() -> str:
    """The same spans in SQL: positions from split texts, parts paired by range within a document."""
    part = []
    for i, k in enumerate(secrets.KINDS):
        p = _sql_pattern(k.pattern)
        good = "".join(f" AND regexp_matches(m, '{_sql_pattern(v)}')" for v in k.valid)
        part.append(
            f"SELECT r, {i} AS k, '{k.name}' AS name, '{k.role}' AS role, s, s + length(m) AS e FROM ("
            f"SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS s "
            f"FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}'))) WHERE true{good}"
        )
    base, scope = secrets.BASE, secrets.SCOPE
    near = lambda r: f"EXISTS (SELECT 1 FROM p WHERE p.r = w.r AND p.role = '{r}' AND abs(p.s - w.s) <= {scope} OR p.r = w.r AND p.role = '{r}' AND p.s // {scope} = w.s // {scope})"
    line = "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k, e){f}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{k.name}" for i, k in enumerate(secrets.KINDS[:base]))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS MATERIALIZED (SELECT r, k, name, role, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ({' UNION ALL '.join(part)})),
p AS MATERIALIZED (SELECT * FROM a WHERE k < {base} OR NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.k < {base} AND b.s < a.e AND a.s < b.e)),
f AS (SELECT * FROM p w WHERE k < {base} OR (role = 'id' AND {near('secret')}) OR (role = 'secret' AND {near('id')}) OR (role = 'endpoint' AND {near('id')} AND {near('secret')}))
SELECT doc_id, {counts}, sha256({line.format(f=f' FILTER (WHERE k < {base})')}) AS base_sha256, {line.format(f='')} AS spans
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""


@query("op3_secrets", _sql())
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
