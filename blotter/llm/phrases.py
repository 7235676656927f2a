"""Collocations: frequent phrases of two to four words, scored by their weakest cut, per language.

Words are numbered exactly within a chunk of documents; a chunk's n-grams get Rabin-Karp fingerprints from numpy prefix
polynomials (64-bit arithmetic, wrapping). Each chunk hands on one row per different n-gram: fingerprint, count, a pointer
to one occurrence (hash of the document, number of the word) and 32 bits of a second polynomial. The shuffle adds up the
counts per fingerprint. Where the second polynomials of a fingerprint differ, it stands for several phrases, and all
pointers of that fingerprint are kept instead of one. Pointers of frequent fingerprints are joined with the documents, cut
out of the text and counted again by the words themselves, so only frequent phrases are ever written out.

A pair is only frequent if both words are, and a longer n-gram if all pairs in it are, so the frequent ones are looked up in
a bitmap of fixed size (false hits cost rows, never results).

``A-Z`` are lower-cased, pieces end at ``. , ; : ! ?`` and line breaks (0A to 0D), words are cut at blanks and tabs. Null texts are
empty, a null language is ``und``. Repeated rows count each; ties follow the stated order; texts are read whole, in
stretches. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import quoted, stretches
from blotter.session import cut_lineage

LONGEST = 4
LEAST = 30
TOP = 2000
UNKNOWN = "und"
#: Slices of a language's phrases that are ranked apart before they are ranked together.
SLICES = 64
#: Words a chunk holds.
CHUNK = 2_000_000
#: Shares of a chunk's fingerprints that are sorted one after the other, and places whose fingerprints are computed at once.
SHARES, STEP = 8, 1 << 16
#: Bits of the bitmap of frequent fingerprints; 16 MiB.
BITMAP = 1 << 27
#: Odd multipliers of the polynomials.
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
POWERS = [pow(BASE, j, 1 << 64) for j in range(64)]
BREAK = b"\xff"  # in no UTF-8 text
FOLD = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, ``BREAK`` between pieces, in lists of bounded size."""
    # Only blanks are left between words, so cutting at white space cuts at blanks.
    return (part.replace(BREAK, b" \xff ").split() for part in stretches(data.translate(FOLD)))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    at = 1
    while at < n:
        step = np.uint64(pow(base, at, 1 << 64))
        out[at : 2 * at] = out[: min(at, n - at)] * step
        at *= 2
    return out


class _Chunk:
    """Words of many texts as numbers, with the document and the place of each."""

    def __init__(self):
        self.ids, self.parts, self.size, self.langs = _Ids({BREAK: 0}), [], 0, {}

    def add(self, numbers: np.ndarray, doc: int, first: int, lang: str, known: int) -> None:
        """A stretch of a document whose first word has the number ``first``; n-grams within its ``known`` first words were counted."""
        self.parts.append((numbers, doc, first, self.langs.setdefault(lang, len(self.langs)), known))
        self.size += len(numbers)

    def grams(self, orders: tuple[int, ...], pairs: np.ndarray | None, shorter: int, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(fingerprint, mark, count, document, word) of every different n-gram, n in ``orders``, and the words per language.

        Only n-grams whose ``shorter``-grams are all in the bitmap ``pairs`` count. A mark is 32 bits of the second polynomial
        below the number n.
        """
        import xxhash

        size = self.size
        ids = np.concatenate([p[0] for p in self.parts])
        sizes = np.array([len(p[0]) for p in self.parts])
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        # The number of a word within its document counts words only.
        real = np.cumsum(ids != 0, dtype=np.int32)
        before = np.concatenate([[0], real])[ends - sizes]
        lang = np.array([p[3] for p in self.parts], np.int64)
        docs, firsts, known = (np.array([p[j] for p in self.parts], np.int64) for j in (1, 2, 4))
        self.parts = []
        lists = list(self.ids)
        hashed, again = (np.array([xxhash.xxh64_intdigest(w, seed) for w in lists], np.uint64) for seed in (42, 43))
        tongue = np.array([xxhash.xxh64_intdigest(t.encode(), 7) for t in self.langs], np.uint64)
        powers = _powers(BASE, size)
        powers *= hashed[ids]
        prefix = np.zeros(size + 1, np.uint64)
        np.cumsum(powers, out=prefix[1:])
        del powers
        back = _powers(pow(BASE, -1, 1 << 64), size + 1)
        # Breaks, and the ends of stretches, lie ahead at this distance.
        places = np.arange(size, dtype=np.int32)
        room = np.where(ids == 0, places, np.int32(size))
        room = np.minimum.accumulate(room[::-1])[::-1]
        room = np.minimum(room, ends.astype(np.int32)[which])
        room -= places
        del places
        low = np.uint64(MASK >> (64 - bits))

        def fingerprints(places: np.ndarray, m: int) -> np.ndarray:
            out = np.empty(len(places), np.uint64)
            for start in range(0, len(places), STEP):
                at = places[start : start + STEP]
                poly = (prefix[at + m] - prefix[at]) * back[at] + tongue[lang[which[at]]] * np.uint64(2 * m + 1)
                poly ^= poly >> np.uint64(29)
                poly *= np.uint64(OTHER)
                poly ^= poly >> np.uint64(32)
                out[start : start + STEP] = poly & low
            return out

        def starts(n: int) -> np.ndarray:
            return np.flatnonzero(room >= n).astype(np.int32)

        if orders[0] == 1:
            # One row per language counts all its words; its place is -1, its n is 0.
            counts = np.bincount(lang[which], weights=ids != 0, minlength=len(self.langs)).astype(np.int64)
            for k in np.flatnonzero(counts):
                doc = docs[np.argmax(lang == k)]
                yield tongue[k : k + 1] & low, tongue[k : k + 1] >> np.uint64(32), counts[k : k + 1], np.array([doc]), np.array([-1])
        if pairs is not None:
            # The shorter n-gram at each place is looked up once, then a longer one needs a run of them.
            usual = np.zeros(size + 1, np.int32)
            at = starts(shorter)
            usual[at[has(pairs, fingerprints(at, shorter))] + 1] = 1
            usual = np.cumsum(usual, dtype=np.int32)
        for n in orders:
            at = starts(n)
            at = at[at + n > (ends - sizes + known).astype(np.int32)[which[at]]]
            if pairs is not None:
                span = n - shorter + 1
                at = at[usual[at + span] - usual[at] == span]
            every, numbers = at, fingerprints(at, n)
            for share in range(SHARES):
                mine = numbers % np.uint64(SHARES) == share
                at, fp = every[mine], numbers[mine]
                if not len(at):
                    continue
                order = np.argsort(fp, kind="stable")
                fp, at = fp[order], at[order]
                first = np.concatenate([[True], fp[1:] != fp[:-1]])
                group = np.cumsum(first) - 1
                same = lang[which[at]] == lang[which[at[first]]][group]
                for j in range(n):
                    same &= ids[at + j] == ids[at[first] + j][group]
                if not same.all():
                    # Fingerprints that several phrases of the chunk share: sort those by the words.
                    keys = np.column_stack([group, lang[which[at]], *(ids[at + j] for j in range(n))])
                    order = np.lexsort(keys.T[::-1])
                    keys, fp, at = keys[order], fp[order], at[order]
                    first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
                start = np.flatnonzero(first)
                at, fp = at[start], fp[start]
                second = tongue[lang[which[at]]].copy()
                for j in range(n):
                    second = (second ^ again[ids[at + j]]) * np.uint64(OTHER)
                    second ^= second >> np.uint64(31)
                place = real[at] - 1 - before[which[at]] + firsts[which[at]]
                yield fp, second >> np.uint64(32) | np.uint64(n << 32), np.diff(np.append(start, len(first))), docs[which[at]], place


def fingerprint(found: list[bytes], lang: str, bits: int = 64) -> int:
    """The fingerprint of one phrase, as chunks have it, as a signed number."""
    import xxhash

    poly = xxhash.xxh64_intdigest(lang.encode(), 7)
    if found:
        poly *= 2 * len(found) + 1
        for j, word in enumerate(found):
            poly += xxhash.xxh64_intdigest(word, 42) * POWERS[j]
        poly &= MASK
        poly ^= poly >> 29
        poly = poly * OTHER & MASK
        poly ^= poly >> 32
    poly &= MASK >> (64 - bits)
    return poly - (1 << 64) if poly >> 63 else poly


def has(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    bit = fp & np.uint64(BITMAP - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap_of(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the fingerprints in ``fp``; at most ``BITMAP`` / 64 rows come to the driver, whatever the data."""
    bit = F.col("fp").bitwiseAND(BITMAP - 1)
    cells = frequent.select(F.shiftright(bit, 6).alias("cell"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _partials(docs: DataFrame, orders: tuple[int, ...], pairs: np.ndarray | None, shorter: int, bits: int) -> DataFrame:
    """Rows of ``_Chunk.grams`` over ``docs`` (``doc``, ``lang``, ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None
    longest = orders[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            for fp, second, count, doc, place in chunk.grams(orders, shared.value if shared else None, shorter, bits) if chunk.size else ():
                for at in range(0, len(fp), 100_000):
                    cut = slice(at, at + 100_000)
                    columns = [fp[cut].view(np.int64), second[cut].astype(np.int64), count[cut], doc[cut], place[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["fp", "mark", "c", "doc", "place"])

        chunk = _Chunk()
        for batch in batches:
            for doc, lang, text in zip(*(batch.column(i) for i in range(3))):
                doc, lang, carry, first = doc.as_py(), lang.as_py(), [], 0
                for found in words((text.as_py() or "").encode()):
                    # The last words before a cut are read again, so that n-grams across it count.
                    found = carry + found
                    chunk.add(np.fromiter(map(chunk.ids.__getitem__, found), np.int32, len(found)), doc, first, lang, len(carry))
                    carry = found[max(len(found) - longest + 1, 0) :] if longest > 1 else []
                    first += len(found) - found.count(BREAK) - len(carry) + carry.count(BREAK)
                    if chunk.size >= CHUNK:
                        yield from flush(chunk)
                        chunk = _Chunk()
        yield from flush(chunk)

    return docs.mapInArrow(run, "fp long, mark long, c long, doc long, place long")


def _frequent(docs: DataFrame, orders: tuple[int, ...], pairs: np.ndarray | None, shorter: int, least: int, bits: int) -> DataFrame:
    """Pointers of n-grams whose fingerprints are frequent: ``fp``, ``doc``, ``place``, ``c``, ``n``, written to shared storage."""
    partials = _partials(docs, orders, pairs, shorter, bits)
    sums = partials.groupBy("fp").agg(
        F.sum("c").alias("c"), F.first("doc").alias("doc"), F.first("place").alias("place"), F.min("mark").alias("mark"), F.max("mark").alias("other")
    )
    kept = cut_lineage(sums.filter((F.col("c") >= least) | (F.col("place") < 0)))
    shared = kept.filter("mark <> other").select("fp")
    single = kept.filter("mark = other").select("fp", "doc", "place", "c", "mark")
    if not shared.isEmpty():
        # Several phrases under one fingerprint: all its pointers are read from the text.
        pointers = partials.join(shared.hint("shuffle_merge"), "fp", "left_semi")
        # Equal rows in several chunks have equal pointers.
        single = single.unionByName(pointers.groupBy("fp", "doc", "place", "mark").agg(F.sum("c").alias("c")))
        single = cut_lineage(single)
    return single.select("fp", "doc", "place", "c", F.shiftright("mark", 32).cast("int").alias("n"))


def _cut_out(docs: DataFrame, pointers: DataFrame, bits: int) -> DataFrame:
    """(``lang``, ``phrase``, ``n``, ``c``) of pointers, from the texts they point to; phrases must have the fingerprint."""
    lists = pointers.groupBy("doc").agg(F.collect_list(F.struct("place", "n", "c", "fp")).alias("points"))
    joined = docs.join(lists, "doc").select("doc", "lang", "text", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, lang, text = (batch.column(k)[i].as_py() for k in range(3))
                whole = [w for part in words((text or "").encode()) for w in part if w != BREAK]
                points = batch.column(3).slice(i, 1).flatten()
                place, n, c, fp = (points.field(k).to_numpy() for k in range(4))
                for at in range(0, len(place), 50_000):
                    cut = slice(at, at + 50_000)
                    found = [whole[p : p + m] if p >= 0 else [] for p, m in zip(place[cut].tolist(), n[cut].tolist())]
                    right = [len(w) == m and fingerprint(w, lang, bits) == f for w, m, f in zip(found, n[cut].tolist(), fp[cut].tolist())]
                    size, text_of = len(found), [b" ".join(w).decode() for w in found]
                    columns = [pa.array([lang] * size, pa.string()), pa.array(text_of, pa.string()), pa.array(n[cut], pa.int32()), pa.array(c[cut], pa.int64()), pa.array(fp[cut], pa.int64()), pa.array([doc] * size, pa.int64()), pa.array(place[cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "c", "fp", "doc", "place"]).filter(pa.array(right, pa.bool_()))

    cut = joined.mapInArrow(run, "lang string, phrase string, n int, c long, fp long, doc long, place long")
    # A document that stands in several equal rows answers its pointers several times.
    return cut.groupBy("fp", "doc", "place", "n", "lang", "phrase").agg(F.first("c").alias("c"))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", longest: int = LONGEST, least: int = LEAST, bits: int = 64) -> DataFrame:
    """Frequent phrases of 1 to ``longest`` words, and under an empty phrase the words of each language.

    ``bits`` of a fingerprint are used; fewer make collisions likelier and change no result. The result lies in shared
    storage: ``lang``, ``phrase``, ``n`` (words), ``f``.
    """
    string, tongue = F.col(quoted(text)).cast("string"), F.coalesce(F.col(quoted(lang)).cast("string"), F.lit(UNKNOWN))
    keyed = docs.select(F.xxhash64(F.col(quoted(doc_id)), tongue, string).alias("doc"), tongue.alias("lang"), string.alias("text")).filter("text is not null")
    # Words first, then pairs of frequent words, then whatever consists of frequent pairs.
    plan = [(1,), (2,), tuple(range(3, longest + 1))]
    bitmap, pointers = None, None
    for at, orders in enumerate(o for o in plan if o and o[0] <= longest):
        frequent = _frequent(keyed, orders, bitmap, at, least, bits)
        pointers = frequent if pointers is None else pointers.unionByName(frequent)
        if orders[-1] < longest:
            bitmap = bitmap_of(frequent.filter("n > 0").select("fp"))
    phrases = _cut_out(keyed, pointers, bits).groupBy("lang", "phrase", "n").agg(F.sum("c").alias("f"))
    return cut_lineage(phrases.filter(f"f >= {int(least)} or n = 0"))


def collocations(found: DataFrame, top: int | None = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of ``counts`` (None: all): ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Every part of a frequent phrase is frequent too, so its count is in ``found``. Arithmetic is decimal.
    """
    parts = found.filter("n > 0").select("lang", F.col("phrase").alias("part"), F.col("f"))
    candidates = found.filter("n > 1").withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
    piece = lambda i, k: F.concat_ws(" ", F.slice("w", i, k))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(28,0))) div (cast(l as decimal(28,0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # The most frequent longer candidate around each shorter one.
    inner = candidates.filter("n > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
    around = inner.groupBy("lang", piece(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter("longer is null or cast(longer as decimal(28,0)) * 100 < cast(a as decimal(28,0)) * 80")
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    rows = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    best_first = (F.desc("score"), F.desc("a"), "phrase")
    if top is not None:
        # A language is first cut down within slices, so that none is sorted whole in one task.
        rows = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best_first))).filter(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
