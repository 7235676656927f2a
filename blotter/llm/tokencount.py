"""Token counts by byte-pair merging over a heap and a linked list, without emitting identifiers.

The symbols of a pre-token, at first its bytes, form a linked list; a heap holds the adjacent pairs that the merge list
knows, lowest rank first and leftmost among equals. Each pop that is still valid joins two symbols, so the count is the
number of bytes less the number of merges. A text is first cut at the vocabulary's added tokens (each is one token), then
into pre-tokens by the byte-level pattern.

Null texts count as empty and have no tokens. Texts are read whole, whatever their length; rows are independent, so ties,
repeated rows and other columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blotter.llm.common import fresh_name, map_arrow

#: Pre-tokens of which a worker remembers the count, in each of two generations; only speed depends on it.
REMEMBERED = 150_000
#: Characters of a text whose pre-tokens are listed at once.
STRETCH = 1 << 20
#: The pattern of byte-level pre-tokens (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points that newer Unicode tables call letters or numbers and the library's don't (fixed values, hexadecimal).
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F
12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F
"""


def newer_class() -> str:
    """``NEWER`` as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08X}" for end in run.split("-")) for run in NEWER.split())


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def read_merges(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """Of a byte-level BPE file: the symbol of each byte, (left, right) to (rank, joined), and the added tokens.

    Files with other models, normalisers or pre-tokenisers raise.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or whole.get("normalizer") or odd:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary {odd}")
    vocab = model["vocab"]
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
    added = [t["content"] for t in whole.get("added_tokens") or ()]
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in whole.get("added_tokens") or ()):
        raise ValueError(f"{path}: added tokens with own rules for their surroundings")
    return [vocab[c] for c in byte_letters()], pairs, added


def merges(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges the rank order makes of ``symbols`` (which are changed)."""
    last = len(symbols)
    before, after = list(range(-1, last - 1)), list(range(1, last + 1))
    heap = [(found[0], i, found[1]) for i, pair in enumerate(zip(symbols, symbols[1:])) if (found := pairs.get(pair))]
    heapify(heap)
    done = 0
    while heap:
        _, i, joined = heappop(heap)
        j = after[i]
        # A pair is stale once one of its symbols was joined to another: the pair there now gives another symbol.
        if symbols[i] < 0 or j >= last or (found := pairs.get((symbols[i], symbols[j]))) is None or found[1] != joined:
            continue
        done += 1
        symbols[i], symbols[j] = joined, -1
        k = after[i] = after[j]
        if k < last:
            before[k] = i
            if found := pairs.get((joined, symbols[k])):
                heappush(heap, (found[0], i, found[1]))
        h = before[i]
        if h >= 0 and (found := pairs.get((symbols[h], joined))):
            heappush(heap, (found[0], h, found[1]))
    return done


class _Remembered(dict):
    """Counts by pre-token; computes what it doesn't hold and forgets what was not met for a generation."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, part: str) -> int:
        n = self.older.get(part)
        if n is None:
            n = self.compute(part)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[part] = n
        return n


class Counter:
    """Count the tokens of whole texts."""

    def __init__(self, first: list[int], pairs: dict[tuple[int, int], tuple[int, int]], added: list[str]):
        import regex

        self.first, self.pairs = first, pairs
        self.pattern = regex.compile(PATTERN)
        self.newer = regex.compile(f"[{newer_class()}]")
        # Slower, so only for texts with such code points.
        older = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\s[\p{L}\p{N}--[NEWER]]]").replace(r"?\p{L}", r"?[\p{L}--[NEWER]]").replace(r"?\p{N}", r"?[\p{N}--[NEWER]]")
        self.older = regex.compile("(?V1)" + older.replace("NEWER", newer_class()))
        longest = sorted(added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.known = _Remembered(self.part)

    def part(self, part: str) -> int:
        data = part.encode()
        return len(data) - merges([self.first[b] for b in data], self.pairs)

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))

    def _plain(self, text: str) -> int:
        find = self.older if self.newer.search(text) else self.pattern
        if len(text) <= STRETCH:
            return sum(map(self.known.__getitem__, find.findall(text)))
        return sum(self.known[m.group()] for m in find.finditer(text))


def count(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with one more column, the number of tokens of the whole text as ``long``.

    ``path`` is the vocabulary's JSON file, read on the driver; its merges (of fixed size) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_merges(path))
    where = docs.columns.index(text)
    name = fresh_name(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(*shared.value)
            # One text at a time: a batch of long texts is never whole in Python strings.
            counts = [counter.count(t.as_py() or "") for t in batch.column(where)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return map_arrow(docs, run, schema)
