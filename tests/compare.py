"""Compare a registered query with its SQL counterpart the way the checks do."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


# How each engine names the same type.
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
    "tinyint": "TINYINT", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]",
}


def compare(spark, con, name, fn, sql, folder):
    """(problems, rows, seconds in Spark)."""
    start = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return [], len(rows), seconds
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    other = cursor.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
        return problems, len(rows), seconds
    for column, kind in df.dtypes:
        if SAME.get(kind) != kinds[column]:
            problems.append(f"type of {column}: {kind} vs {kinds[column]}")
    mine, theirs = _sorted(rows, df.columns), _sorted(other, names)
    if len(mine) != len(theirs):
        problems.append(f"{len(mine)} rows vs {len(theirs)}")
    elif mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems, len(rows), seconds
