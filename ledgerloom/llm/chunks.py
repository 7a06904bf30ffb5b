"""Encoding texts by white-space chunks with a bounded cache; shared by the two tokenizer operators."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


def _alone(key: str) -> bool:
    """Whether a chunk's ids don't depend on its neighbours: no white space meets the spaces around it."""
    if key[0] == " ":
        return not key[1:] or not key[-1].isspace()
    return not (key[0].isspace() or key[-1].isspace())


class ChunkCache:
    """Ids of texts, each distinct chunk encoded once while it stays in the cache.

    A single space between non-space characters always begins a token of the byte-level pattern, so
    a text without runs of white space splits there into chunks that are encoded apart. Other texts
    are encoded whole. ``encode_many`` maps strings to ids, unsigned 32-bit bytes; at most ``most``
    chunks are kept, then the cache starts anew, which changes no result. The ids lie in one array,
    with each chunk's bounds, so that looking up a text is a few array operations.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = 800_000):
        self.encode_many, self.most = encode_many, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bounds, self.ids = np.zeros(1 << 12, dtype=np.int64), np.empty(1 << 14, dtype=np.uint32)

    def _learn(self, keys: list[str]) -> None:
        """Keys are chunks; only a text's first one has a space, which isn't its own."""
        found = self.encode_many([k[1:] if k[0] == " " else " " + k for k in keys])
        n, sizes = len(self.number), [len(x) // 4 for x in found]
        ends = self.bounds[n] + np.cumsum(sizes)
        while n + len(keys) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.bounds[n] : ends[-1]] = np.frombuffer(b"".join(found), dtype="<u4")
        self.bounds[n + 1 : n + 1 + len(keys)] = ends
        self.number.update(zip(keys, range(n, n + len(keys))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin (and the last one's end)."""
        if len(self.number) > self.most:
            self._clear()
        keys: list[str] = []
        sizes = np.empty(len(texts), dtype=np.int64)
        for i, x in enumerate(texts):
            own = x.split(" ")
            own[0] = " " + own[0]
            sizes[i] = len(own)
            keys += own
        at = np.fromiter(map(self.number.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        odd = {}
        if len(new := np.flatnonzero(at < 0)):
            distinct = dict.fromkeys(keys[j] for j in new)
            if fit := [k for k in distinct if k and _alone(k)]:
                self._learn(fit)
            at[new] = [self.number.get(keys[j], -1) for j in new]
            text_of = np.repeat(np.arange(len(texts)), sizes)
            odd = {int(i): texts[i] for i in np.unique(text_of[at < 0])}
            at = np.maximum(at, 0)
        start, size = self.bounds[at], self.bounds[np.minimum(at + 1, len(self.bounds) - 1)] - self.bounds[at]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        if odd:
            parts = np.split(ids, bounds[1:-1])
            for i, own in zip(odd, self.encode_many(list(odd.values()))):
                parts[i] = np.frombuffer(own, dtype="<u4")
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds
