"""Exact removal of repeated substrings, with shards sorted by external induction.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the table. To bring equal strings
together, every window of ``length`` bytes is led by its smallest hashed ``GRAM`` (the leftmost of equal ones); equal windows
have equal leaders. Neighbouring windows with the same leader travel as one stretch, so a window is sent once.

Stretches are counted by leader and content first. A content met twice repeats whole. Leaders with several contents are
dealt to shards, and each shard is ordered by induced sorting with common prefixes (``induced``): windows whose neighbours
share ``length`` bytes repeat. A leader with more than ``HOT`` contents gets finer keys instead of one shard: its stretches
are cut into blocks by the leader's place in the window, and a block is led by the bytes that all its windows share, so
equal windows still meet. Blocks are counted by content and sorted as before, and get smaller while a key has too many
contents; a block of one window is its own key. What repeats is joined back to all places of a content.

Null texts count as empty. Every row counts, so rows with equal texts repeat each other whole, whatever their identifiers.
Very long texts are cut into chunks of windows that overlap in bytes only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import fresh_name, quoted
from blotter.llm.induced import MAPPED, Scratch, suffix_order
from blotter.session import cut_lineage

LENGTH = 400
GRAM = 128
#: Contents of one leader that a shard may get; with more, its stretches are cut and led by longer strings.
HOT = 512
#: How many times smaller blocks get from one key to the finer one.
FINER = 4
#: Bytes of a shard.
SHARD_BYTES = 1 << 20
CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15
BATCH_ROWS = 256
#: Low bits of a marked hash that hold its place.
INDEX = np.uint64((1 << 19) - 1)
#: Tables a worker computes once.
KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if "powers" in KEPT:
        return KEPT["powers"]
    size = CHUNK + 2 * LENGTH + GRAM
    back = pow(BASE, -1, 1 << 64)
    grow = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
    KEPT["powers"] = grow(np.uint64(BASE)), grow(np.uint64(back))
    return KEPT["powers"]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    up, down = _powers()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    x = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from minima within blocks on both sides."""
    count = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.append(values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _marked(hashes: np.ndarray) -> np.ndarray:
    """Hashes with their place in the low bits, which makes the leftmost of equal leaders the smallest."""
    return hashes & ~INDEX | np.arange(len(hashes), dtype=np.uint64)


def _runs(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``stretches`` of one chunk after the other, as arrays."""
    for start in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8)[start : start + CHUNK + length - 1]
        hashes = _gram_hashes(part, gram)
        lead = (_window_minima(_marked(hashes), length - gram + 1) & INDEX).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1])
        sizes = np.diff(np.append(first, len(lead)))
        yield hashes[lead[first]].view(np.int64), first + start, sizes


def stretches(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(leader hash, first window, number of windows) of every run of windows with one leader."""
    for part in _runs(data, length, gram):
        yield from zip(*(column.tolist() for column in part))


def blocks(data: bytes, length: int, gram: int, block: int) -> Iterator[tuple[int, int, bytes]]:
    """(first window, number of windows, bytes that every window of the whole block holds) of a stretch's blocks.

    Blocks go by the leader's place in the window, so that equal windows of other stretches lie in the same block, and a
    stretch that has one window of a block has all the shared bytes.
    """
    windows = len(data) - length + 1
    place = int(np.argmin(_marked(_gram_hashes(np.frombuffer(data, np.uint8)[:length], gram))))
    low = 0
    while low < windows:
        # The last window of the block has the leader at the smallest place.
        last = low + (place - low) % block
        yield low, min(last + 1, windows) - low, data[last : last - block + 1 + length]
        low = last + 1


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _flat(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


def _places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Every stretch of every text (``_d``, ``_h``, ``_t``): leader, content digest, place and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                rows, out, digests = [], [], []
                for i, data in enumerate(batch.column(2).to_pylist()):
                    for part in _runs(data, length, gram):
                        out.append(part)
                        rows.append(np.full(len(part[0]), i))
                        digests += [digest(data[a:b]) for a, b in zip(part[1].tolist(), (part[1] + part[2] + (length - 1)).tolist())]
                if rows:
                    take = pa.array(np.concatenate(rows), pa.int64())
                    lead, first, size = (np.concatenate(c) for c in zip(*out))
                    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    table = (lead, halves[:, 0].copy(), halves[:, 1].copy(), first, size.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, table)], ["_d", "_h", "lead", "s1", "s2", "at", "n"])

    long = T.LongType()
    schema = _flat([("_d", docs.schema["_d"].dataType), ("_h", long), ("lead", long), ("s1", long), ("s2", long), ("at", long), ("n", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` stretches, from the texts that hold them: ``lead``, ``s1``, ``s2``, ``n``, ``hot``, ``data``."""
    lists = wanted.groupBy("_d", "_h").agg(F.collect_list(F.struct("lead", "s1", "s2", "at", "n", "hot")).alias("parts"))
    # Equal rows hold the same bytes; one of them will do.
    left, right = docs.alias("l"), lists.alias("r")
    joined = right.join(left, F.col("l._d").eqNullSafe(F.col("r._d")) & (F.col("l._h") == F.col("r._h"))).select("_t", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                rows = []
                for row in whole.slice(at, BATCH_ROWS).to_pylist():
                    for p in row["parts"]:
                        data = row["_t"][p["at"] : p["at"] + p["n"] + length - 1]
                        rows.append({"lead": p["lead"], "s1": p["s1"], "s2": p["s2"], "n": p["n"], "hot": p["hot"], "data": data})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("lead", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int32()), ("hot", pa.bool_()), ("data", pa.binary())]))

    return joined.mapInArrow(run, "lead long, s1 long, s2 long, n int, hot boolean, data binary")


def _blocks(hot: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """The blocks of stretches: key, digest and windows of each, the stretch it is from, its first window there and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for batch in (whole.slice(at, BATCH_ROWS) for at in range(0, whole.num_rows, BATCH_ROWS)):
                rows = []
                for s1, s2, data in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "data"))):
                    for low, n, shared in blocks(data, length, gram, block):
                        own = data[low : low + n + length - 1]
                        b1, b2 = _halves(digest(own))
                        rows.append({"lead": _halves(digest(shared))[0], "b1": b1, "b2": b2, "n": n, "s1": s1, "s2": s2, "base": low, "data": own})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("lead", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("base", pa.int32()), ("data", pa.binary())]))

    return hot.select("s1", "s2", "data").mapInArrow(run, "lead long, b1 long, b2 long, n int, s1 long, s2 long, base int, data binary")


def sides(data: bytes, length: int, gram: int) -> tuple[bytes | None, bytes | None]:
    """The leader with half of a window's other bytes before it and after it, where a content has them.

    Equal windows have the leader at the same place, so they share one of the two.
    """
    half = -(-(length - gram) // 2)
    place = int(np.argmin(_marked(_gram_hashes(np.frombuffer(data, np.uint8)[:length], gram))))
    end = place + gram
    return data[place - half : end] if place >= half else None, data[place : end + half] if end + half <= len(data) else None


def _shard(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Order one shard and give, per content, the windows that another place of the shard repeats.

    Contents that share neither side of their leader with another one have no such window and are not sorted.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    scratch = Scratch()
    try:
        every, before, after = [], [], []
        path = scratch.path()
        with open(path, "wb") as file:
            for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
                for s1, s2, n, data in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "n", "data"))):
                    file.write(data)
                    every.append((s1, s2, n, len(data)))
                    for held, side in zip((before, after), sides(data, length, gram)):
                        held.append(None if side is None else digest(side))
        met = Counter(before), Counter(after)
        met[0][None] = met[1][None] = 0
        shared = [met[0][a] > 1 or met[1][b] > 1 for a, b in zip(before, after)]
        keys, sizes, total = [], [], 0
        symbols = scratch.path()
        with open(path, "rb") as file, open(symbols, "wb") as sorted_:
            for (s1, s2, n, size), wanted in zip(every, shared):
                data = file.read(size)
                if wanted:
                    # Bytes are symbols from 2 on, 1 ends a content, 0 ends the shard.
                    sorted_.write((np.frombuffer(data, np.uint8).astype(np.uint16) + 2).tobytes() + b"\x01\x00")
                    keys.append((s1, s2))
                    sizes.append((total, n))
                    total += size + 1
            sorted_.write(b"\x00\x00")
        if not keys:
            return
        text = np.memmap(symbols, np.uint16, "r") if total > MAPPED else np.fromfile(symbols, np.uint16)
        order, prefix = suffix_order(text, length, scratch=scratch)
        valid = np.zeros(total + 1, bool)
        for start, n in sizes:
            valid[start : start + n] = True
        group = np.cumsum(prefix < length) - 1
        group[0:1] = 0
        kept = valid[order]
        order, group = order[kept], group[kept]
        met = np.bincount(group, minlength=1)
        repeated = np.zeros(total + 1, bool)
        repeated[order[met[group] > 1]] = True
        rows = []
        for (s1, s2), (start, n) in zip(keys, sizes):
            own = np.flatnonzero(np.diff(np.concatenate([[False], repeated[start : start + n], [False]]).astype(np.int8)))
            rows += [{"s1": s1, "s2": s2, "low": int(a), "high": int(b)} for a, b in own.reshape(-1, 2)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))
    finally:
        scratch.close()


def _repeats(parts: DataFrame, length: int, gram: int, hot: int, shard_bytes: int, block: int) -> DataFrame:
    """Runs of windows (``s1``, ``s2``, ``low``, ``high``) that different contents of a leader share.

    ``parts``, in shared storage, holds each content once; leaders that are ``hot`` are cut into blocks of ``block`` windows.
    """
    cold, warm = parts.filter("not hot"), parts.filter("hot")
    shards = max(1, -(-(cold.agg(F.sum(F.length("data"))).first()[0] or 0) // shard_bytes))
    dealt = cold.select("lead", "s1", "s2", "n", "data").repartition(int(shards), "lead")
    found = dealt.mapInArrow(lambda batches: _shard(batches, length, gram), "s1 long, s2 long, low int, high int")
    if warm.isEmpty():
        return found
    cut = cut_lineage(_blocks(warm, length, gram, block))
    contents = cut.groupBy("lead", "b1", "b2", "n").agg(F.count("*").alias("times"), F.first("data").alias("data"))
    contents = cut_lineage(contents)
    again = contents.filter("times > 1").select("b1", "b2", F.lit(0).alias("low"), F.col("n").alias("high"))
    if block > 1:
        leads = contents.groupBy("lead").agg(F.count("*").alias("different")).filter("different > 1")
        finer = contents.join(leads, "lead").select("lead", F.col("b1").alias("s1"), F.col("b2").alias("s2"), "n", (F.col("different") > hot).alias("hot"), "data")
        again = again.unionByName(_repeats(cut_lineage(finer), length, gram, hot, shard_bytes, max(1, block // FINER)).toDF("b1", "b2", "low", "high"))
    # Written first, as below.
    back = cut.select("b1", "b2", "s1", "s2", "base").join(cut_lineage(again), ["b1", "b2"])
    return found.unionByName(back.select("s1", "s2", (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high")))


def _joined(runs: Column) -> Column:
    """Sorted runs, those that touch made one."""

    def put(held: Column, run: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], run["high"]).alias("high"))
        touch = (F.size(held) > 0) & (last["high"] >= run["low"])
        return F.when(touch, F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(held, F.array(run)))

    return F.aggregate(runs, F.slice(runs, 1, 0), put)


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stretches of windows that repeat: ``_d``, ``_h``, ``at`` and ``end`` (bytes covered), from ``_d``, ``_h``, ``_t``."""
    places = _places(docs, length, gram)
    one = F.struct("_d", "_h", "at")
    contents = places.groupBy("lead", "s1", "s2", "n").agg(F.count("*").alias("times"), F.min(one).alias("one"))
    contents = cut_lineage(contents)
    leads = contents.groupBy("lead").agg(F.count("*").alias("different")).filter("different > 1")
    whole = contents.filter("times > 1").select("s1", "s2", F.lit(0).alias("low"), F.col("n").alias("high"))
    wanted = contents.join(leads, "lead").select("lead", "s1", "s2", "n", "one.*", (F.col("different") > hot).alias("hot"))
    parts = cut_lineage(_contents(docs, wanted, length))
    found = whole.unionByName(_repeats(parts, length, gram, hot, shard_bytes, max(1, (length - gram + 1) // FINER)))
    spans = found.groupBy("s1", "s2").agg(_joined(F.array_sort(F.collect_set(F.struct("low", "high")))).alias("spans"))
    # Written first, so that both sides are shuffled for the join and a content with many places may be split.
    hit = places.join(cut_lineage(spans), ["s1", "s2"]).select("_d", "_h", "at", F.explode("spans").alias("span"))
    return hit.select("_d", "_h", (F.col("at") + F.col("span.low")).alias("at"), (F.col("at") + F.col("span.high") - 1 + length).alias("end"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``removed``.

    ``removed`` holds the maximal removed runs as (start, end) in bytes of the UTF-8 text.
    """
    keep = docs.columns if keep is None else keep
    string = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*map(quoted, keep)).alias("_row"), F.col(quoted(doc_id)).alias("_d"), F.xxhash64(string).alias("_h"), string.cast("binary").alias("_t"))
    spans = covered(keyed.filter(F.length("_t") >= length).select("_d", "_h", "_t"), length, gram, hot, shard_bytes)
    cover = spans.groupBy("_d", "_h").agg(F.collect_set(F.struct("at", "end")).alias("cover"))
    left, right = keyed.alias("l"), cover.alias("r")
    joined = left.join(right, F.col("l._d").eqNullSafe(F.col("r._d")) & (F.col("l._h") == F.col("r._h")), "left").select("_row", "_t", "cover")
    names = [fresh_name(docs.select(*map(quoted, keep)), n) for n in ("kept", "n_bytes", "n_removed", "removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            kept, cuts = [], []
            for data, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs: list[list[int]] = []
                for c in sorted(cover or (), key=lambda c: c["at"]):
                    if runs and c["at"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], c["end"])
                    else:
                        runs.append([c["at"], c["end"]])
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
                cuts.append([{"start": a, "end": b} for a, b in runs])
            sizes = [len(d) for d in batch.column(1).to_pylist()]
            gone = [n - len(k) for n, k in zip(sizes, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, span)], ["_row", *names])

    kinds = ("binary", "long", "long", "array<struct<start:long,end:long>>")
    schema = T.StructType([joined.schema["_row"], *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds))])
    return joined.mapInArrow(run, schema).select("_row.*", *names)
