"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints have 64 bits and link at two or fewer differing bits. A fingerprint is cut into three segments. Two linked
fingerprints agree in one whole segment (two errors can't touch three), and in every other segment they differ in at most
two bits. The binary Golay code is perfect: every 23-bit word lies within three bits of exactly one codeword. Two words at
most two bits apart share the codeword of some word within one bit of either, so the codeword indices of a segment and of
its one-bit neighbours (one or six as a rule) serve as fuzzy keys. Keys are (exact segment, fuzzy key of the next one);
what shares a key is joined and verified.

A key with more than ``BUCKET`` distinct fingerprints is refined: the bits outside the exact segment are cut into six
pieces, of which linked fingerprints share four, then into all choices of two free bits, under which at most four
fingerprints meet. So no bucket is paired beyond ``BUCKET`` and no link is lost.

Equal fingerprints are collapsed before any join. Null or empty texts have fingerprint zero, linked like any other.
Null identifiers are ignored when a component is named (null if it has no other). Repeated rows give repeated rows; texts
are read whole in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import connected_components, fresh_name, map_arrow, quoted
from blotter.session import cut_lineage

SEED = 42
SHINGLE = 3
BITS = 64
#: Widths of the three segments, lowest bits first; each is padded to the 23 bits of the code.
SEGMENTS = (22, 21, 21)
#: Distinct fingerprints a key may hold before it is refined; bounds the pairs per fingerprint, loses none.
BUCKET = 64
BLOCK = 1 << 16
#: Tables a worker computes once.
KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b101011100011


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of a whole text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with ``out``, the fingerprint as a signed ``long``."""
    keep = docs.columns if keep is None else keep
    at, kept_at = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    name = fresh_name(docs.select(*map(quoted, keep)), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept_at), pa.array(found)], [*(batch.schema.names[i] for i in kept_at), name])

    return map_arrow(docs, run, T.StructType([*(docs.schema.fields[i] for i in kept_at), T.StructField(name, T.LongType())]))


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and the error pattern (three bits at most) of every syndrome."""
    if "code" in KEPT:
        return KEPT["code"]

    def remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    single = np.array([remainder(1 << i) for i in range(23)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(single[list(places)])] = sum(1 << p for p in places)
    KEPT["code"] = single, errors
    return KEPT["code"]


def fuzzy_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and of its one-bit neighbours, one row per word; -1 where one repeats."""
    single, errors = _code()
    syndrome = np.zeros(len(words), np.int64)
    for i in range(width):
        syndrome ^= np.where(words >> i & 1, single[i], 0)
    flips = np.concatenate([[0], 1 << np.arange(width, dtype=np.int64)])
    near = words[:, None] ^ flips
    index = np.sort((near ^ errors[syndrome[:, None] ^ np.concatenate([[0], single[:width]])]) >> 11, 1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of ``prints``; a key packs segment number, exact segment and fuzzy index of the next."""
    parts, start = [], 0
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64))
        start += width
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        index = fuzzy_keys(parts[j], SEGMENTS[j])
        row, column = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(i << 34 | parts[i][row] << 12 | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@cache
def _masks() -> tuple[list[list[tuple[int, int]]], dict[tuple[int, int], list[int]]]:
    """Per segment the (number, mask) that keep it and four of six pieces; per such mask those that free two bits only."""
    coarse, fine, start = [], {}, 0
    full = (1 << BITS) - 1
    for i, width in enumerate(SEGMENTS):
        rest = [b for b in range(BITS) if not start <= b < start + width]
        pieces = [sum(1 << b for b in rest[p::6]) for p in range(6)]
        own = []
        for number, (p, q) in enumerate(combinations(range(6), 2)):
            free = pieces[p] | pieces[q]
            own.append((number, _signed(full ^ free)))
            fine[i, number] = [_signed(full ^ (1 << x | 1 << y)) for x, y in combinations([b for b in rest if free >> b & 1], 2)]
        coarse.append(own)
        start += width
    return coarse, fine


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def _pairs(members: DataFrame, by: list[str]) -> DataFrame:
    left = members.select(*by, F.col("fp").alias("fp_a"), F.col("first").alias("first_a"))
    right = members.select(*by, F.col("fp").alias("fp_b"), F.col("first").alias("first_b"))
    pairs = left.join(right, by).filter((F.col("fp_a") < F.col("fp_b")) & _near("fp_a", "fp_b"))
    return pairs.select(F.struct(F.col("first_a").alias("first"), F.col("fp_a").alias("fp")).alias("a"), F.struct(F.col("first_b").alias("first"), F.col("fp_b").alias("fp")).alias("b"))


def _counted(members: DataFrame, by: list[str]) -> DataFrame:
    """Members of groups of two or more, with their number ``n``, written to the shared folder."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    return cut_lineage(members.join(sizes, by))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs of distinct fingerprints that link; ``prints`` has ``fp`` (distinct) and ``first``, an orderable value.

    Returns ``a`` and ``b``, structs of ``first`` and ``fp``; a pair may come more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                row, key = keys_of(part.column(0).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(row)) for c in part.columns)], ["key", "fp", "first"])

    kind = prints.schema["first"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("first", kind)])
    members = _counted(prints.select("fp", "first").mapInArrow(run, schema), ["key"])
    found = _pairs(members.filter(F.col("n") <= bucket), ["key"])
    hot = members.filter(F.col("n") > bucket).select(F.shiftright("key", 34).cast("int").alias("segment"), "fp", "first").distinct()
    if hot.isEmpty():
        return found
    coarse, fine = _masks()
    pieces = F.array(*(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(m).alias("mask")) for n, m in own)) for own in coarse))
    split = hot.select("segment", "fp", "first", F.explode(F.get(pieces, F.col("segment"))).alias("m"))
    split = split.select("segment", F.col("m.number").alias("number"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("kept"), "fp", "first")
    members = _counted(split, ["segment", "number", "kept"])
    found = found.unionByName(_pairs(members.filter(F.col("n") <= bucket), ["segment", "number", "kept"]))
    hot = members.filter(F.col("n") > bucket)
    if hot.isEmpty():
        return found
    frees = F.create_map(*(x for k, ms in fine.items() for x in (F.lit(k[0] * 100 + k[1]), F.array(*(F.lit(m) for m in ms)))))
    split = hot.select(F.posexplode(frees[F.col("segment") * 100 + F.col("number")]).alias("free", "mask"), "segment", "number", "fp", "first")
    split = split.select("segment", "number", "free", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "fp", "first")
    return found.unionByName(_pairs(split, ["segment", "number", "free", "kept"]))


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest identifier reachable) of every row of ``docs``."""
    own = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    prints = cut_lineage(fingerprints(own, keep=["doc_id"], out="fp"))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected_components(links(firsts))
    named = labels.groupBy("component").agg(F.min("node.first").alias("name"))
    renamed = labels.join(named, "component").select(F.col("node.fp").alias("fp"), "name")
    classes = firsts.join(renamed, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    # Written first, so that both sides are shuffled for the join and a fingerprint of many documents may be split.
    return prints.join(cut_lineage(classes), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest identifier stays.

    Among equal identifiers the text hash decides, among equal rows any one stays. Null identifiers come first.
    """
    key, row = fresh_name(docs, "_k"), F.col(quoted(doc_id))
    own = docs.select(row.alias("d"), F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))).alias("h"), F.col(quoted(text)).cast("string").alias("text"))
    prints = cut_lineage(fingerprints(own, keep=["d", "h"], out="fp").groupBy("d", "h", "fp").agg(F.count("*").alias("rows")))
    firsts = prints.groupBy("fp").agg(F.min(F.struct("d", "h")).alias("first"))
    labels = connected_components(links(firsts))
    moved = labels.select(F.col("node.fp").alias("fp"), F.col("component.fp").alias("kept"))
    keepers = firsts.join(moved, "fp", "left").filter("kept is null or kept = fp").select("first.*").alias("k")
    keepers = keepers.join(prints.alias("p"), F.col("k.d").eqNullSafe(F.col("p.d")) & (F.col("k.h") == F.col("p.h"))).select("k.*", "rows")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))))
    stay = keyed.join(keepers, row.eqNullSafe(F.col("d")) & (F.col(quoted(key)) == F.col("h")))
    once = stay.filter("rows = 1").select(*map(quoted, docs.columns))
    if prints.filter("rows > 1").isEmpty():
        return once
    again = stay.filter("rows > 1").dropDuplicates([doc_id, key])
    return once.unionByName(again.select(*map(quoted, docs.columns)))
