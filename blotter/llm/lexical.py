"""Ranked lexical search over posting lists in geometric blocks with exact summary bounds.

Documents become sparse vectors of integer impacts over the terms of the queries. Tasks take them in shards; within a shard
every term's posting list is clustered by the similarity of its documents (random projections of their weighted vectors,
centres drawn from the list), and each block stores the largest impact per term that any of its documents has. A query
goes through its terms, best first. The product of the query and a block's summary bounds the score of all its documents,
so a block whose bound stays below the 20th best score so far is skipped, and any other is scored exactly. Bounds that
equal that score are not skipped, for ties go to the smaller identifier. Results are exact.

Shards lie within input partitions, so no document is shuffled, and no posting list is ever whole in one task. Queries
travel in blocks of ``BLOCK_CHARS`` characters (a longer query is a block of its own), one pass over the documents each.

Terms are runs of ASCII letters and digits and of all code points from 80 (hexadecimal) on; only A-Z are lower-cased. Null texts have
no term; documents and queries without terms take no part. Repeated documents count each; repeated queries (equal identifier
and text) are one query. Null identifiers sort first. Texts are read whole. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import map_arrow, quoted, stretches
from blotter.session import cut_lineage, scratch_path

TOP = 20
BLOCK_CHARS = 1_000_000
#: Terms whose impacts a shard holds at once, cells of that table, and documents of a shard.
COLUMNS, CELLS, SHARD = 4096, 1 << 23, 4096
#: Documents of a block, about, and dimensions in which documents are compared.
BLOCK, DIMENSIONS = 64, 16
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    return (part.split() for part in stretches((text or "").encode().translate(FOLD)))


class _Known(dict):
    def __missing__(self, term: bytes) -> int:
        return -1


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(``id``, ``n``, ``terms``, ``tf``) of ``docs`` (identifier, text): number of terms, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        for batch in batches:
            sizes, found, counts, where = [], [], [], [0]
            for text in batch.column(1):
                n, ids = 0, []
                for part in terms(text.as_py()):
                    n += len(part)
                    ids.append(np.fromiter(map(known.__getitem__, part), np.int32, len(part)))
                ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
                own, tf = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(n)
                found.append(own)
                counts.append(tf)
                where.append(where[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.concatenate(c) if c else [], pa.int32())) for c in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tf"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", docs.schema[0].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tf", ints)])
    return map_arrow(docs, run, schema)


class Shard:
    """Documents over a few terms: impacts, and per term the blocks of its posting list with their summaries."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, size: int, weights: np.ndarray, beside: list[np.ndarray]):
        """``rows``, ``columns``, ``impacts`` are the postings by document; ``beside[t]`` the terms that share a query with ``t``."""
        width = len(weights)
        self.table = np.zeros((size, width), np.int32)
        self.table[rows, columns] = impacts
        self.most = self.table.max(axis=0, initial=0).astype(np.int64)
        directions = np.random.default_rng(42).choice([-1.0, 1.0], (width, DIMENSIONS)).astype(np.float32)
        points = np.zeros((size, DIMENSIONS), np.float32)
        if len(rows):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            points[rows[starts]] = np.add.reduceat(directions[columns] * (impacts * weights[columns]).astype(np.float32)[:, None], starts, axis=0)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        order = np.argsort(columns, kind="stable")
        ends = np.searchsorted(columns[order], np.arange(width + 1))
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(width):
            listed = rows[order[ends[t] : ends[t + 1]]]
            starts = np.zeros(min(len(listed), 1), np.int64)
            if len(listed) > BLOCK:
                centres = listed[:: BLOCK]
                nearest = np.argmax(points[listed] @ points[centres].T, axis=1)
                by = np.argsort(nearest, kind="stable")
                listed, starts = listed[by], np.flatnonzero(np.diff(nearest[by], prepend=-1))
            summary = np.maximum.reduceat(self.table[np.ix_(listed, beside[t])], starts, axis=0) if len(listed) else np.zeros((0, len(beside[t])), np.int32)
            self.blocks.append((listed, starts, summary))

    def search(self, query: np.ndarray, weights: np.ndarray, beside: list[np.ndarray], least: int, offer) -> int:
        """Hand all documents that may be among the best to ``offer(rows, scores)``, which gives the new least score.

        ``query`` are the different terms, ``weights`` their weights in it. Returns how many documents were scored.
        """
        order = np.argsort(-weights * self.most[query], kind="stable")
        # What a document can have at most that holds none of the terms so far.
        rest = np.cumsum((weights * self.most[query])[order][::-1])[::-1]
        seen, scored = np.zeros(len(self.table), bool), 0
        for place, i in enumerate(order):
            if rest[place] < least:
                break
            t = query[i]
            listed, starts, summary = self.blocks[t]
            if not len(listed):
                continue
            bounds = summary[:, np.searchsorted(beside[t], query)] @ weights
            ends = np.append(starts[1:], len(listed))
            # Best block first, so that the least score rises early; the others are then scored together.
            best = int(np.argmax(bounds))
            for chosen in (np.array([best]), np.delete(np.arange(len(bounds)), best)):
                chosen = chosen[bounds[chosen] >= least]
                if not len(chosen):
                    continue
                rows = np.concatenate([listed[starts[b] : ends[b]] for b in chosen])
                rows = rows[~seen[rows]]
                seen[rows] = True
                scored += len(rows)
                if len(rows):
                    least = offer(rows, self.table[np.ix_(rows, query)] @ weights)
        return scored


class _Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def offer(self, names, rows: np.ndarray, scores: np.ndarray) -> int:
        keep = scores >= self.least
        if keep.any():
            new = [(-s, name is not None, name) for s, name in zip(scores[keep].tolist(), (names[r].as_py() for r in rows[keep].tolist()))]
            self.rows = sorted(self.rows + new, key=lambda r: r[:2] + ((r[2],) if r[1] else ()))[: self.top]
            if len(self.rows) == self.top:
                self.least = max(1, -self.rows[-1][0])
        return self.least


def _parts(queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[int], np.ndarray]]:
    """Queries in order, grouped so that each group has at most ``COLUMNS`` terms (or one query): numbers and terms."""
    out, numbers, held = [], [], np.empty(0, np.int64)
    for i, (own, _) in enumerate(queries):
        joined = np.union1d(held, own)
        if numbers and len(joined) > COLUMNS:
            out.append((numbers, held))
            numbers, joined = [], own
        numbers, held = [*numbers, i], joined
    return [*out, (numbers, held)] if numbers else out


def _ranked(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(``query``, ``id``, ``score``): per task and query the best documents of ``found`` (see ``vectors``)."""
    shared = found.sparkSession.sparkContext.broadcast((queries, weights, _parts(queries)))

    def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n and n + piece.num_rows > size:
                    yield pa.concat_batches(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, parts = shared.value
        bests = [_Best(top) for _ in queries]
        plans = []
        for numbers, held in parts:
            local = [np.searchsorted(held, queries[q][0]) for q in numbers]
            sets: list[list[np.ndarray]] = [[] for _ in held]
            for own in local:
                for t in own:
                    sets[t].append(own)
            beside = [np.unique(np.concatenate(s)) for s in sets]
            place = np.full(len(weights), -1)
            place[held] = np.arange(len(held))
            plans.append((numbers, local, beside, place, weights[held]))
        width = max(len(held) for _, held in parts)
        size = max(16, min(SHARD, CELLS // width))
        kind = None
        for shard in shards(batches, size):
            names, sizes, lists, counts = (shard.column(i) for i in range(4))
            kind = names.type
            n = sizes.to_numpy()
            scale = 75 + 25 * n * documents // length
            rows = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            found, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 12 * scale[rows])
            for numbers, local, beside, place, own_weights in plans:
                columns = place[found]
                held = columns >= 0
                index = Shard(rows[held], columns[held], impacts[held], len(n), own_weights, beside)
                for q, query in zip(numbers, local):
                    best = bests[q]
                    index.search(query, queries[q][1] * own_weights[query], beside, best.least, lambda r, s: best.offer(names, r, s))
        flat = [(q, name, -score) for q, best in enumerate(bests) for score, _, name in best.rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind), pa.array([f[2] for f in flat], pa.int64())], ["query", "id", "score"])

    schema = T.StructType([T.StructField("query", T.IntegerType()), found.schema["id"], T.StructField("score", T.LongType())])
    return map_arrow(found, run, schema)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(identifier, text) rows in lists of about ``BLOCK_CHARS`` characters, fetched one partition at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[1])
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The ``top`` best documents of each item: item identifier, ``rank``, document identifier, ``score``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    asked = cut_lineage(items.select(F.col(quoted(item_id)).alias("item"), F.col(quoted(item_text)).cast("string").alias("text")).filter("text is not null").distinct())
    kinds = (asked.schema["item"].dataType, plain.schema["id"].dataType)
    out = spark.createDataFrame([], T.StructType([T.StructField("item", kinds[0]), T.StructField("rank", T.IntegerType()), T.StructField("id", kinds[1]), T.StructField("score", T.LongType())]))
    for block in _blocks(asked):
        vocabulary: dict[bytes, int] = {}
        queries = []
        for _, words in block:
            ids = [vocabulary.setdefault(t, len(vocabulary)) for part in terms(words) for t in part]
            queries.append(np.unique(np.array(ids, np.int64), return_counts=True))
        if not vocabulary:
            continue
        path = scratch_path(spark, "vectors")
        vectors(plain, vocabulary).write.parquet(path)
        found = spark.read.parquet(path)
        # At most one row per term of the block comes to the driver.
        held = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        documents, length = found.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        ranked = _ranked(found.filter("n > 0"), queries, weights, documents, length, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", kinds[0])]))
        out = out.unionByName(cut_lineage(names.join(ranked, "query").select("item", "rank", "id", "score")))
    return out.toDF(item_id, "rank", doc_id, "score")
