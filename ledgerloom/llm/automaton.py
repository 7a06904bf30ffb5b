"""BPE as a deterministic automaton over tokens, compiled from the merges by one gadget after the other."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import add_vocabulary, byte_letters

#: Stands for the end of a word in spelled words and tokens; no byte letter is U+0000.
END = "\0"
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*").fullmatch
LETTERS = dict(enumerate(byte_letters()))


class MergeAutomaton:
    """The automaton whose paths are exactly the token sequences that BPE makes of words.

    At first one state has a loop for each base symbol. The gadget of merge (u, v): all arcs of u lead to one state q; where q has
    an arc of v, they are led to a copy of q that lacks it, and beside each arc of u runs a new arc uv to where v led from q.
    So a word's tokens spell a path iff no merge was left undone, and each prefix of a word has one path only.

    Copies are kept as differences: a state holds its original, the one arc that it lacks and the merge that made it. Whether
    state q has an arc of t is read from these tables: a state older than t has it iff it has one of t's left part; a younger one
    iff it doesn't lack it and its original has it. Arcs of one token all end in one state, ``target``.
    A merge that never comes to pass (its parts never meet) makes no arc. Every token must come from one merge, of parts
    that are older; other vocabularies raise an error, as greedy BPE on them isn't what an automaton of this kind does.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def spelled(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and token.endswith(suffix) else token

        self.label = {i: token for token, i in vocab.items()}
        made = {u + v for u, v in merges}
        if len(made) < len(merges):
            raise ValueError("two merges make one token")
        self.born = {i: 0 for token, i in vocab.items() if token not in made}
        self.target = dict.fromkeys(self.born, 0)
        self.left: dict[int, int] = {}
        self.original, self.lacks, self.made_by = [0], [-1], [0]
        self._steps: dict[tuple[int, int], bool] = {}
        for k, (u, v) in enumerate(merges, 1):
            a, b, ab = vocab[u], vocab[v], vocab[u + v]
            if a not in self.born or b not in self.born:
                raise ValueError(f"merge {k} joins a part that is younger than itself")
            self.born[ab], self.left[ab] = k, a
            q, after = self.target.get(a), self.target.get(b)
            if q is None or after is None or not self._has_arc(q, b):
                continue
            self.original.append(q)
            self.lacks.append(b)
            self.made_by.append(k)
            self.target[a], self.target[ab] = len(self.original) - 1, after
        self.arc = {spelled(self.label[i]): i for i in self.target}
        self.longest = max(map(len, self.arc), default=0)

    def _has_arc(self, q: int, t: int) -> bool:
        """Of a token with arcs at all."""
        while q:
            if self.made_by[q] > self.born[t]:
                if self.lacks[q] == t:
                    return False
                q = self.original[q]
            else:
                t = self.left[t]
        return True

    def step(self, q: int, t: int) -> int:
        """The state behind q's arc of t, or -1."""
        if (found := self._steps.get((q, t))) is None:
            if len(self._steps) > 2_000_000:
                self._steps.clear()
            found = self._steps[q, t] = t in self.target and self._has_arc(q, t)
        return self.target[t] if found else -1

    def encode(self, word: str) -> list[int]:
        """The one path of a word of byte letters; an error if there is none, as where a letter has no symbol.

        Depth first, longest arcs first. As each place in the word is reached by one path at most, a place that led
        nowhere is left for good: the time is linear in the word's length.
        """
        if not word:
            return []
        word += END
        arc, steps, target, longest, end, dead = self.arc.get, self._steps, self.target, self.longest, len(word), set()
        path, places, at, state, reach = [], [], 0, 0, min(len(word), longest)
        while True:
            for to in range(reach, at, -1):
                if (t := arc(word[at:to])) is not None and to not in dead and (steps[state, t] if (state, t) in steps else self.step(state, t) >= 0):
                    if to == end:
                        return [*path, t]
                    path.append(t)
                    places.append((at, state, to - 1))
                    at, state, reach = to, target[t], min(to + longest, end)
                    break
            else:
                if not path:
                    raise ValueError(f"no path spells {word[:-1]!r}")
                dead.add(at)
                path.pop()
                at, state, reach = places.pop()


class WordCodec:
    """Encodes and decodes texts by a tokenizer file: its normaliser and word splitter, then the automaton.

    Special tokens in a text are cut out first. As no word holds white space, and normalisation doesn't work across it, each
    piece between ASCII white space is encoded once while it stays in a cache of bounded size, which changes no result.
    """

    def __init__(self, path: str, most: int = 500_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or told["decoder"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a plain BPE vocabulary with word ends")
        own = Tokenizer.from_file(path)
        self.normal, self.words = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        splitter = told["pre_tokenizer"].get("pretokenizers", [{}])[0]
        kinds = [n["type"] for n in told["normalizer"].get("normalizers", [])]
        self.split = None
        if kinds == ["NFC", "Replace", "Lowercase"] and splitter.get("behavior") == "Removed" and splitter.get("invert"):
            self.split = regex.compile(splitter["pattern"]["Regex"]).findall
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.labels = self.automaton.label | {i: token for token, i in self.special.items()}
        self.most, self.pieces, self.known = most, {}, {}

    def _words(self, text: str) -> list[str]:
        """What the file's normaliser and splitter make of a text, in byte letters. A text of ASCII signs and Latin-1 letters is its own
        normal form but for upper case, and the split pattern reads it alike in every library; others are left to the library."""
        if self.split and PLAIN(text):
            words = self.split(text.lower())
            return words if text.isascii() else [w.encode().decode("latin-1").translate(LETTERS) for w in words]
        return [word for word, _ in self.words(self.normal(text))]

    def _plain(self, text: str) -> list[int]:
        out = []
        for word in self._words(text) if text else ():
            if (ids := self.known.get(word)) is None:
                ids = self.automaton.encode(word)
                if len(word) < 200:
                    self.known[word] = ids
            out += ids
        return out

    def _piece(self, piece: bytes) -> bytes:
        text, out, at = piece.decode(), [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [*self._plain(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return np.array(out + self._plain(text[at:]), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        pieces = text.encode().split()  # by the six ASCII white-space bytes
        if len(self.pieces) > self.most or len(self.known) > self.most:
            self.pieces, self.known = {}, {}
        for piece in set(pieces).difference(self.pieces):
            self.pieces[piece] = self._piece(piece)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids' arcs, a space between two, as the tokenizer file has no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(file: str) -> WordCodec:
    return WordCodec(SparkFiles.get(file))


def encode_words(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded string) for each row, ids as little-endian unsigned 32-bit integers.

    One narrow pass without a shuffle; each Python worker compiles the automaton once from the vocabulary file, of a fixed size.
    A null or empty text gives no ids and an empty text, repeated rows give repeated rows, null ids stay null, other columns are not
    read, an empty table gives no rows, and very long texts and words are encoded whole, in time linear in their length.
    """
    file = add_vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = [codec.encode(x) for x in part.column(1).to_pylist()]
                plain = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
