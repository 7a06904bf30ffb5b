"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .common import small_batches


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: bytes, float or (two's complement) integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece r + 1 is the token of rank r, byte-mapped, with score -r.

    Normalisation is the identity, without dummy prefix, white-space removal or escapes. Piece 0 is
    the unknown piece that the library demands. Ranks must be 0, 1, 2, ... without gaps.
    """
    letters = byte_letters()
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for r, (token, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if r != rank:
            raise ValueError(f"rank {r} is missing")
        pieces.append(_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class PieceCodec:
    """Encodes pre-tokens by the piece model and decodes ids by the inverse mapping."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        of = {c: b for b, c in enumerate(letters)}
        names = [self.pieces.id_to_piece(i) for i in range(1, self.pieces.get_piece_size())]
        self.bytes_of = [bytes(of[c] for c in name) for name in names]
        self.whole = {name: i for i, name in enumerate(names)}
        self.cache = ChunkCache(self._encode_many)

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        words = [[w.encode().decode("latin-1").translate(self.to_letters) for w in self.split(x)] for x in texts]
        new = list({w for ws in words for w in ws if w not in self.whole})
        ids = {w: [i - 1 for i in found] for w, found in zip(new, self.pieces.encode(new, num_threads=1) if new else [])}
        return [array("I", [i for w in ws for i in ((self.whole[w],) if w in self.whole else ids[w])]).tobytes() for ws in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin."""
        return self.cache.encode(texts)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks_file: str, pattern: str) -> PieceCodec:
    return PieceCodec(piece_model(read_ranks(SparkFiles.get(ranks_file))), pattern)


def add_vocabulary(spark: SparkSession, path: str) -> str:
    """Give executors the vocabulary file, of a fixed size, by Spark's own file distribution; returns its name there."""
    name = path.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(path)
    return name


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for each row; one narrow pass, no shuffle.

    A null or empty text gives no ids and empty bytes; repeated rows give repeated rows; other
    columns are not read; very long texts are encoded whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks_file = add_vocabulary(spark, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_file, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids, bounds = codec.encode(part.column(1).to_pylist())
                plain = ids.tolist()
                decoded = [codec.decode(plain[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
