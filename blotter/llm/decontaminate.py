"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and white space becomes single blanks. An item of n characters may be found with
k = floor(n x ``rate``) edits anywhere in a text. It is cut into k + 1 pieces; k edits leave one piece whole, so every leak
holds a piece exactly where the item would lie. One automaton finds all pieces of all items in one pass over a text, and
the stretches around hits are verified with Myers' bit-parallel distance.

Items travel to the executors in blocks of bounded size; more blocks mean more passes over the documents, and every item
meets every whole text. Null or empty texts leak nothing. Items of fewer than ``least`` characters are found without edits
and at word borders only; items that are null or blank are left out. Repeated rows and items are reported each; null identifiers stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import map_arrow, quoted

RATE = 0.07
LEAST = 32
#: Characters of items in one pass; an automaton takes some hundred bytes for each.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in ``errors`` + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distance(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any stretch of ``text``, and where that stretch first ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, where = size, 0
    for at, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = ((equal & plus) + plus ^ plus | equal) & full
        up = minus | full & ~(across | plus)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, where = score, at
        up, down = up << 1 & full, down << 1 & full
        plus = down | full & ~(vertical | up)
        minus = up & vertical
    return best, where


def _bordered(text: str, at: int) -> bool:
    """Whether no word goes on across position ``at``."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


class Matcher:
    """Find items of one block in normalised texts."""

    def __init__(self, items: list[str], rate: float, least: int = LEAST):
        import ahocorasick

        self.items = items
        self.short = [len(t) < least for t in items]
        self.errors = [0 if short else int(len(t) * rate) for t, short in zip(items, self.short)]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(items):
            for offset, piece in pieces(item, self.errors[i]):
                found.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, start of the searched stretch, end of the match) of every item that ``text`` holds."""
        if not self.any or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - size - offset)
        out = []
        for i, where in sorted(starts.items()):
            item, errors = self.items[i], self.errors[i]
            if self.short[i]:
                whole = next((s for s in sorted(where) if _bordered(text, s) and _bordered(text, s + len(item))), None)
                out += [] if whole is None else [(i, 0, whole, whole + len(item))]
                continue
            stretches: list[list[int]] = []
            for s in sorted(where):
                low, high = max(0, s - errors), min(len(text), s + len(item) + errors)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(high, stretches[-1][1])
                else:
                    stretches.append([low, high])
            best = None
            for low, high in stretches:
                exact = text.find(item, low, high)
                if exact >= 0:
                    best = (0, exact, exact + len(item))
                    break
                masks = self.masks.setdefault(i, letter_masks(item)) if i not in self.masks else self.masks[i]
                edits, end = distance(masks, len(item), text[low:high])
                if edits <= errors and (best is None or edits < best[0]):
                    best = (edits, low, low + end)
            if best:
                out.append((i, *best))
        return out


def _blocks(items: DataFrame, text: str, item_id: str, block_chars: int) -> Iterator[list[tuple]]:
    """Items as lists of (identifier, normalised text), each list within about ``block_chars`` characters."""
    rows = items.select(F.col(quoted(item_id)).alias("id"), F.col(quoted(text)).cast("string").alias("text")).filter("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, blocks))))
    for block in range(blocks):
        found = [(r["id"], normal(r["text"])) for r in rows.filter(F.col("block") == block).collect()]
        yield sorted((x for x in found if x[1]), key=lambda x: (x[0] is not None, x[0], x[1]))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_text: str = "text", item_id: str = "item_id", rate: float = RATE, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row of ``docs`` with leaks, and for each pass: columns ``keep`` and ``leaks``.

    ``leaks`` is an array of (item_id, edits, end): the item, the fewest edits it is found with, and the end of that
    stretch in the normalised text.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    at, kept_at = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    kind = items.schema[item_id].dataType
    hit = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("edits", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(docs.schema.fields[i] for i in kept_at), T.StructField("leaks", hit)])

    def one(block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher, ids = None, [i for i, _ in shared.value]
            for batch in batches:
                matcher = matcher or Matcher([t for _, t in shared.value], rate, least)
                rows, found = [], []
                for i, t in enumerate(batch.column(at).to_pylist()):
                    hits = matcher.find(normal(t))
                    if hits:
                        rows.append(i)
                        found.append([{"item_id": ids[h[0]], "edits": h[1], "end": h[3]} for h in hits])
                part = batch.take(pa.array(rows, pa.int64()))
                inner = pa.list_(pa.struct([("item_id", pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()), ("edits", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept_at), pa.array(found, inner)], [*(part.schema.names[i] for i in kept_at), "leaks"])

        return map_arrow(docs, run, schema)

    found = None
    for block in _blocks(items, item_text, item_id, block_chars):
        part = one(block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else one([])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", rate: float = RATE, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no item, by one pass for each block of items."""
    at = docs.columns.index(text)
    for block in _blocks(items, item_text, item_id, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(shared.value, rate, least)
                yield batch.filter(pa.array([not matcher.find(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
