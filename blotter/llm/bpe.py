"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte stands for one letter, every token for the piece of its bytes' letters, and a piece's score is its negative
rank, so sentencepiece merges in rank order. Normalisation is the identity. Text is cut into pre-tokens by the
vocabulary's pattern, each pre-token is encoded on its own, and decoding maps identifiers back to bytes.

Null texts count as empty and give no tokens. Texts are encoded whole, whatever their length; rows are independent, so
ties, repeated rows and other columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blotter.llm.common import fresh_name, map_arrow

#: Letters that stand for the bytes 0 to 255.
FIRST_LETTER = 0x100
#: Distinct pre-tokens a worker remembers before it starts anew; only speed depends on it.
REMEMBERED = 400_000
#: Rows an output batch holds at most.
BATCH_ROWS = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order; ranks must run from 0 without gaps."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


#: The letter of every byte, by the character of its number.
LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of ``tokens``: identifier = rank, the unknown piece comes last.

    Field numbers are those of the public sentencepiece model format (fixed values).
    """
    pieces = [_block(1, _block(1, letters(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(i)) + _number(3, 1)) for i, t in enumerate(tokens)]
    unknown = len(tokens)
    pieces.append(_block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    # model_type BPE; vocab_size; unk, bos, eos and pad identifiers (absent ones are -1 as 64-bit varints)
    absent = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, unknown) + b"".join(_number(f, absent) for f in (41, 42, 43))
    # name; no dummy prefix, no removal and no escaping of white space
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encode whole texts to identifiers."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The identifiers as 32-bit numbers in a row."""
        # A text may hold several groups in its pattern; findall gives strings as long as there is none.
        parts = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self._learn(set(parts))
            return b"".join(map(self.known.__getitem__, parts))

    def _learn(self, parts: set[str]) -> None:
        known = self.known
        new = [p for p in parts if p not in known]
        if len(known) > REMEMBERED:
            known.clear()
            new = list(parts)
        rest = []
        for part in new:
            data = part.encode()
            whole = self.rank.get(data)
            if whole is None:
                rest.append((part, letters(data)))
            else:
                known[part] = whole.to_bytes(4, sys.byteorder)
        if rest:
            for (part, _), ids in zip(rest, self.piece.encode([x for _, x in rest], out_type=int, num_threads=1)):
                known[part] = array("i", ids).tobytes()

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(start, BATCH_ROWS)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with one more column, the token identifiers of the whole text as ``array<int>``.

    ``path`` is the rank file, read on the driver; its tokens (a vocabulary, of fixed size) are broadcast.
    """
    spark = docs.sparkSession
    tokens = read_ranks(path)
    shared = spark.sparkContext.broadcast((tokens, serialise(tokens), pattern))
    where = docs.columns.index(text)
    name = fresh_name(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in _slices(whole):
                encoder = encoder or Encoder(*shared.value)
                packed = [encoder.packed(t or "") for t in batch.column(where).to_pylist()]
                ends = np.cumsum([0, *map(len, packed)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return map_arrow(docs, run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with one more column, the bytes of the identifiers in ``ids`` as ``binary`` (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    where = encoded.columns.index(ids)
    name = fresh_name(encoded, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.binary())
        for whole in batches:
            for batch in _slices(whole):
                column = batch.column(where)
                # Tokens are taken in one piece and cut where lists end; null lists are empty.
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                _, bounds, data = tokens.take(column.flatten()).buffers()
                bounds = np.frombuffer(bounds, np.int32)[np.cumsum([0, *sizes])]
                texts = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), data or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])
    return map_arrow(encoded, run, schema)
