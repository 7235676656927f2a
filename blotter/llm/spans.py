"""Repeated sentence spans: hash every run of several consecutive sentences, join globally, cut all but the first.

A sentence ends after ``.``, ``!`` or ``?`` before white space, and at line breaks. A run holds ``sentences`` sentences and
``words`` words, or two sentences and ``PAIR_WORDS`` words, or ``LONE_WORDS`` words in any number of sentences. From each
sentence the shortest run that starts there and the shortest that ends there are taken, so a repeated passage of whole
sentences that is a run itself is covered from end to end. Runs compare case-folded with single blanks.
A run is only repeated if all its sentences are, so sentences are counted first, by hash, and only runs of sentences met
twice are hashed and shuffled.
Occurrences are ordered by document identifier, then position. Every sentence that a non-first occurrence of a repeated
run covers is removed.

Null texts count as empty: nothing to remove, and the text stays null. Null identifiers come first. Rows with equal
identifier and equal text are one document: they get the same result and do not repeat one another. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import fresh_name, quoted
from blotter.llm.phrases import bitmap_of, has
from blotter.session import cut_lineage, scratch_path

SENTENCES = 3
WORDS = 12
#: Words that make a run of two sentences, and of a single one.
PAIR_WORDS, LONE_WORDS = 12, 51
BATCH_ROWS = 256
CUT = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def pieces(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence, without the white space around it."""
    out, at = [], 0
    for gap in CUT.finditer(text):
        if text[at : gap.start()].strip():
            out.append((at, gap.start()))
        at = gap.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def floors(sentences: int, words: int) -> list[tuple[int, int]]:
    """(sentences, words) that make a run, without those that another one implies."""
    wanted = {(sentences, words), (2, PAIR_WORDS), (1, LONE_WORDS)}
    return sorted(f for f in wanted if not any(g != f and g[0] <= f[0] and g[1] <= f[1] for g in wanted))


def ranges(sizes: list[int], sentences: int, words: int) -> list[tuple[int, int]]:
    """(first sentence, end) of every run, each once, from the words of each sentence."""
    found = set()
    for least, load in floors(sentences, words):
        end = held = 0
        for start in range(len(sizes)):
            while end < len(sizes) and (end - start < least or held < load):
                held += sizes[end]
                end += 1
            if end - start < least or held < load:
                break
            found.add((start, end))
            held -= sizes[start]
        start = held = 0
        for end in range(1, len(sizes) + 1):
            held += sizes[end - 1]
            while end - start > least and held - sizes[start] >= load:
                held -= sizes[start]
                start += 1
            if end - start >= least and held >= load:
                found.add((start, end))
    return sorted(found)


def lines(text: str) -> tuple[list[bytes], list[int]]:
    """Every sentence case-folded with single blanks, and its number of words."""
    folded = [text[s:e].casefold().split() for s, e in pieces(text)]
    return [" ".join(w).encode("utf-8", "replace") for w in folded], [len(w) for w in folded]


def runs(text: str, sentences: int, words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, folded text) of every run, each once."""
    folded, sizes = lines(text)
    for start, end in ranges(sizes, sentences, words):
        yield start, end - start, b"\n".join(folded[start:end])


def _met(docs: DataFrame) -> DataFrame:
    """``fp``: hashes of the sentences that stand in several places; a row of ``docs`` (``_t``) counts on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                found = Counter()
                for text in whole.column(0).slice(at, BATCH_ROWS):
                    found.update(map(xxhash.xxh3_64_intdigest, lines(text.as_py())[0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.int64())], ["fp", "c"])

    counted = docs.select("_t").mapInArrow(run, "fp long, c long").groupBy("fp").agg(F.sum("c").alias("c"))
    return counted.filter("c > 1").select("fp")


def _hashed(docs: DataFrame, sentences: int, words: int) -> DataFrame:
    """A row for each run of each row of ``docs`` (``_d``, ``_h``, ``_t``) whose sentences all stand in several places.

    Other runs can't be repeated. The sentences are looked up in a bitmap of fixed size, whose false hits only cost rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(_met(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                rows, span, starts, counts = [], [], [], []
                for i, text in enumerate(batch.column(2)):
                    folded, sizes = lines(text.as_py())
                    usual = has(shared.value, np.array([xxhash.xxh3_64_intdigest(x) for x in folded], np.uint64))
                    if not usual.any():
                        continue
                    upto = np.concatenate([[0], np.cumsum(usual)]).tolist()
                    for start, end in ranges(sizes, sentences, words):
                        if upto[end] - upto[start] == end - start:
                            rows.append(i)
                            span.append(digest(b"\n".join(folded[start:end])))
                            starts.append(start)
                            counts.append(end - start)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(span, pa.binary()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())],
                    ["_d", "_h", "span", "start", "n"],
                )

    kind = docs.schema["_d"].dataType
    fields = [T.StructField("_d", kind), T.StructField("_h", T.LongType()), T.StructField("span", T.BinaryType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]
    found = docs.mapInArrow(run, T.StructType(fields))
    # Two longs shuffle in less room than a binary.
    half = lambda i: F.conv(F.hex(F.substring("span", i, 8)), 16, -10).cast("long")
    # Written once: the first occurrences and the join back both read it.
    path = scratch_path(docs.sparkSession, "runs")
    found.select("_d", "_h", half(1).alias("s1"), half(9).alias("s2"), "start", "n").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def repeated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """The non-first occurrences of repeated runs: ``_d``, ``_h``, ``start`` and ``n`` (sentences), from ``_d``, ``_h``, ``_t``.

    A run's occurrences are reduced to the first and a count on the map side before they are joined back, so a very
    frequent run is no hot group. The reduced side is written first: both sides of the join are then shuffled for it, and
    adaptive execution may split the large one.
    """
    hashed = _hashed(docs, sentences, words)
    own = F.struct("_d", "_h", "start")
    first = hashed.groupBy("s1", "s2").agg(F.min(own).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    return hashed.join(cut_lineage(first), ["s1", "s2"]).filter(~own.eqNullSafe(F.col("first"))).select("_d", "_h", "start", "n")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sentences: int = SENTENCES, words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with ``kept_text``, ``n_sentences``, ``n_removed`` and ``removed``.

    ``removed`` holds the maximal runs of removed sentences as (start, end) in characters of the text; the gaps before
    removed sentences go with them.
    """
    keep = docs.columns if keep is None else keep
    string = F.col(quoted(text)).cast("string")
    keyed = docs.select(F.struct(*map(quoted, keep)).alias("_row"), F.col(quoted(doc_id)).alias("_d"), F.xxhash64(string).alias("_h"), string.alias("_t"))
    found = repeated(keyed.filter("_t is not null").select("_d", "_h", "_t"), sentences, words)
    cover = found.groupBy("_d", "_h").agg(F.collect_set(F.struct("start", "n")).alias("cover"))
    left, right = keyed.alias("l"), cover.alias("r")
    joined = left.join(right, F.col("l._d").eqNullSafe(F.col("r._d")) & (F.col("l._h") == F.col("r._h")), "left").select("_row", "_t", "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, spans = [], [], [], []
            for t, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                where = pieces(t or "")
                out = set()
                for c in cover or ():
                    out.update(range(c["start"], c["start"] + c["n"]))
                parts, cut, at = [], [], 0
                for i, (_, end) in enumerate(where):
                    if i in out:
                        cut[-1:] = [(cut[-1][0], end)] if cut and cut[-1][1] == at else [*cut[-1:], (at, end)]
                    else:
                        parts.append(t[at:end])
                    at = end
                kept.append(None if t is None else "".join(parts) + t[at:])
                total.append(len(where))
                gone.append(len(out))
                spans.append([{"start": s, "end": e} for s, e in cut])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)], ["_row", *names])

    names = [fresh_name(docs.select(*map(quoted, keep)), n) for n in ("kept_text", "n_sentences", "n_removed", "removed")]
    kinds = ("string", "long", "long", "array<struct<start:int,end:int>>")
    schema = T.StructType([joined.schema["_row"], *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds))])
    return joined.mapInArrow(run, schema).select("_row.*", *names)
