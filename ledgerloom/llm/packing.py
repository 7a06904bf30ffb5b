"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import add_vocabulary, byte_letters
from .chunks import ChunkCache
from .common import small_batches


class Limits(NamedTuple):
    """Of one sequence: tokens, pieces and loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    key: object  # of the example
    ids: np.ndarray  # of this piece
    loss: np.ndarray  # which of them bear loss
    start: int  # ids of the example before it
    total: int  # ids of the example


class VectorPacker:
    """Puts pieces into sequences under three limits at once.

    Pieces wait in a pool of ``pool`` at most. An open sequence takes the waiting piece that fits and
    has the greatest dot product of its sizes with the room left, both in shares of the limits. If
    none fits, the longest is cut at the room that is left, so sequences end full unless the number of
    pieces or the loss limit closes them. What is left at the end is cut at powers of two.
    """

    def __init__(self, limits: Limits, pool: int = 2048):
        self.limits, self.pool = limits, pool
        self.full = np.array(limits, dtype=float)
        self.waiting: list[Piece] = []
        self.open: list[Piece] = []

    def _room(self) -> np.ndarray:
        used = np.array([sum(len(p.ids) for p in self.open), len(self.open), sum(int(p.loss.sum()) for p in self.open)])
        return np.array(self.limits) - used

    @staticmethod
    def _cut(p: Piece, n: int) -> tuple[Piece, Piece | None]:
        rest = Piece(p.key, p.ids[n:], p.loss[n:], p.start + n, p.total) if n < len(p.ids) else None
        return Piece(p.key, p.ids[:n], p.loss[:n], p.start, p.total), rest

    def _longest_head(self, p: Piece, room: np.ndarray) -> int:
        """How many ids of p the room takes."""
        n = int(min(len(p.ids), room[0]))
        bearing = np.cumsum(p.loss[:n])
        return int(np.searchsorted(bearing, room[2], side="right"))

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[Piece]]:
        """Take one example; gives the sequences that became full."""
        p, total = Piece(key, ids, loss, 0, len(ids)), np.array(self.limits)
        while p is not None and len(p.ids) >= self.limits.tokens:
            if (n := self._longest_head(p, total)) == 0:
                raise ValueError("the loss limit must be 1 at least")
            head, p = self._cut(p, n)
            if n == self.limits.tokens:
                yield [head]
            else:
                self.waiting.append(head)
        if p is not None and len(p.ids):
            self.waiting.append(p)
        if len(self.waiting) >= self.pool:
            yield from self._drain(self.pool // 4)

    def _drain(self, least: int) -> Iterator[list[Piece]]:
        """Fill sequences until no more than ``least`` pieces wait."""
        if len(self.waiting) <= least:
            return
        items = self.waiting
        # A row for each limit.
        sizes = np.array([[len(p.ids) for p in items], [1] * len(items), [np.count_nonzero(p.loss) for p in items]], dtype=np.int64)
        shares = sizes / self.full[:, None]
        alive = np.ones(len(items), dtype=bool)
        left = len(items)
        room = self._room()
        while left > least:
            fits = alive & (sizes <= room[:, None]).all(axis=0)
            if fits.any():
                gain = np.where(fits, (room / self.full) @ shares, -1.0)
                i = int(gain.argmax())
                self.open.append(items[i])
                room = room - sizes[:, i]
                alive[i] = False
                left -= 1
            else:
                i = int(np.where(alive, sizes[0], -1).argmax())
                n = self._longest_head(items[i], room) if room[1] > 0 else 0
                if n:
                    head, rest = self._cut(items[i], n)
                    self.open.append(head)
                    room = room - np.array([n, 1, int(head.loss.sum())])
                    items[i] = rest
                    sizes[:, i] = len(rest.ids), 1, int(rest.loss.sum())
                    shares[:, i] = sizes[:, i] / self.full
            if room[0] == 0 or room[1] == 0 or (not fits.any() and n == 0):
                yield self.open
                self.open, room = [], np.array(self.limits)
        self.waiting = [p for p, a in zip(items, alive) if a]

    def finish(self) -> Iterator[list[Piece]]:
        """The rest: whole sequences, then the last open one in parts of a power of two tokens."""
        yield from self._drain(0)
        pieces, self.open = self.open, []
        size = sum(len(p.ids) for p in pieces)
        while size:
            want = part = 1 << size.bit_length() - 1
            row = []
            while want:
                head, rest = self._cut(pieces[0], min(want, len(pieces[0].ids)))
                row.append(head)
                want -= len(head.ids)
                pieces = ([rest] if rest else []) + pieces[1:]
            size -= part
            yield row


class WordEncoder:
    """Ids of texts by a byte-level tokenizer whose pre-tokens ``pattern`` gives; each distinct one is encoded once while it is remembered.

    The tokenizer gets pre-tokens ready, in its own byte alphabet, many in one call. Ids are unsigned 32-bit bytes.
    """

    def __init__(self, path: str, pattern: str, most: int = 800_000, together: int = 500):
        import regex
        from tokenizers import Tokenizer

        self.whole, self.ready = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ready.pre_tokenizer = None
        self.split, self.most, self.together, self.known = regex.compile(pattern).findall, most, together, {}
        self.to_letters = dict(enumerate(byte_letters()))
        self.letters = np.zeros(self.whole.get_vocab_size(), dtype=np.int64)
        for piece, i in self.whole.get_vocab().items():
            self.letters[i] = len(piece)
        #: Texts of special tokens, which the tokenizer takes out before it splits.
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def _learn(self, words: list[str]) -> None:
        mapped = [w.encode().decode("latin-1").translate(self.to_letters) for w in words]
        parts = [mapped[i : i + self.together] for i in range(0, len(mapped), self.together)]
        found = self.ready.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False)
        for i, (part, e) in enumerate(zip(parts, found)):
            ids = np.array(e.ids, dtype="<u4")
            raw = ids.tobytes()
            # Every letter is in some token, so a pre-token ends where as many letters are behind.
            ends = 4 * (1 + np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum([len(w) for w in part])))
            at = 0
            for w, end in zip(words[i * self.together :], ends.tolist()):
                self.known[w] = raw[at:end]
                at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        split = self.split
        words = [(x,) if x[1:].isalpha() and x[0] == " " else split(x) for x in texts]
        every = "\n".join(texts)
        special = {i for i, x in enumerate(texts) if any(t in x for t in self.special)} if any(t in every for t in self.special) else ()
        for i in special:
            words[i] = ()
        if new := list(set(chain.from_iterable(words)).difference(known)):
            self._learn(new)
        of = known.__getitem__
        out = [of(ws[0]) if len(ws) == 1 else b"".join(map(of, ws)) for ws in words]
        for i in special:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str) -> ChunkCache:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkCache(WordEncoder(SparkFiles.get(name), pattern))


PIECES = "start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, limits: Limits = Limits(), id_column: str = "doc_id", text_column: str = "text", prompt_column: str | None = None) -> DataFrame:
    """Tokenise texts, close each with ``end_id`` and pack them: one row for each piece.

    ``pattern`` is the one by which the byte-level tokenizer splits texts into pre-tokens.

    Columns: doc_id, start (ids of the document before the piece), length, ids (unsigned 32-bit
    little-endian), doc_tokens, loss_tokens, sequence_id, offset (in the sequence). Each task packs
    its own partition, so nothing is shuffled and a lost task is simply packed again. With ``prompt_column``
    (instruction data) the prompt's ids come before the text's, encoded apart, and bear no loss. Else all ids bear
    loss but a document's first, which nothing precedes. A null or empty text or prompt has no ids; a text without any is
    the end id alone. Very long texts are cut; repeated rows and null ids are packed like any other; other columns
    aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    name = add_vocabulary(spark, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = _encoder(name, pattern), VectorPacker(limits)
        sequence = TaskContext.get().partitionId() << 36

        def rows(done: list[list[Piece]], kind) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces in done:
                at = 0
                for p in pieces:
                    out.append((p.key, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, int(p.loss.sum()), sequence, at))
                    at += len(p.ids)
                sequence += 1
            cols = list(zip(*out)) or [()] * 8
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 200):
                part, done = batch.slice(lo, 200), []
                ids, bounds = cache.encode(part.column(1).to_pylist())
                before, starts = cache.encode(part.column(2).to_pylist()) if prompt_column else (ids[:0], np.zeros(part.num_rows + 1, dtype=np.int64))
                for key, a, b, c, d in zip(part.column(0).to_pylist(), bounds, bounds[1:], starts, starts[1:]):
                    own = np.concatenate((before[c:d], ids[a:b], [end_id])).astype(np.uint32)
                    loss = np.ones(len(own), dtype=bool)
                    loss[: max(1, d - c)] = False
                    done += packer.add(key, own, loss)
                yield rows(done, kind)
        if kind is not None:
            yield rows(list(packer.finish()), kind)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), *([F.coalesce(F.col(prompt_column), F.lit("")).alias("prompt")] if prompt_column else []))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")
