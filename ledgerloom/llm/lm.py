"""A hierarchical Pitman-Yor bigram model: restaurants seated by blocked Gibbs sampling, predictives averaged over chains.

Every previous word has a restaurant whose customers are the words that follow it; all of them share one
parent restaurant, whose customers are their tables and whose own base is uniform over the V training tokens
and one unknown token. Several chains are sampled side by side. In a round each chain draws the number of tables
of every pair of words, and of every word in the parent, from its distribution given all other tables as they
were in the round before; a token's probability is averaged over the chains' last states.

Work is cut three ways, so that nothing grows but the number of parts: *blocks* of documents, kept as coded tokens;
*slices* of the vocabulary, by a range of word hashes; *buckets* of pairs, by a hash of the pair, so that no frequent
word makes a large task. Parts talk in rows of packed arrays, whose order both sides know, so that no keys travel back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import forget, materialise, small_batches

#: Tokens of a block at most (but for a longer document), tokens for each bucket of pairs, block words for each slice.
BLOCK_TOKENS, BUCKET_TOKENS, SLICE_WORDS = 1 << 20, 1 << 21, 1 << 21
#: Ids are numbers below 2 ** 32, so that a pair is one unsigned long.
MOST_IDS = 1 << 32
#: The end token; it also stands before a text's first word. No word hashes to it but by chance.
END = np.uint64(0x5EED0E4D)
#: Customers up to which the numbers of seatings are counted one customer at a time, and expected tables from which on saddle points do.
COUNTED, WIDE = 4096, 1000


class Settings(NamedTuple):
    """rounds: of seating all customers anew; chains: sampled side by side; strengths: of contexts and parent."""

    rounds: int = 3
    chains: int = 4
    context_strength: float = 1.0
    parent_strength: float = 10.0
    seed: int = 1


# Seating ----------------------------------------------------------------------------------------------------------


class Seatings:
    """log(S(n, t) / S(n, 1)) for t from 1 to n, or to ``most`` + 1; some states are kept, so that further n are near one.

    S(n, t) is the weight of all seatings of n customers at t tables: S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t).
    In quotients r of neighbours nothing is subtracted and nothing overflows. Beyond COUNTED customers (or four times
    ``most``) log r changes so smoothly with log n that the steps are integrated instead of taken one by one (fourth-order
    Runge-Kutta); the quotients are then right to about seven digits.
    """

    def __init__(self, discount: float, most: int):
        self.discount, self.most, self.limit = discount, most, max(COUNTED, 4 * most)
        self.at, self.every = np.arange(2, most + 2) * discount, max(64, self.limit // 64)
        self.states, self.known, self.last = {1: np.zeros(most)}, {}, None

    def log(self, n: int) -> np.ndarray:
        if n in self.known:
            return self.known[n]
        r = self._integrated(n) if n > self.limit else self._counted(n)
        out = np.concatenate(([0.0], np.cumsum(np.log(r[: n - 1]))))
        if n <= 512:
            self.known[n] = out
        return out

    def _counted(self, n: int) -> np.ndarray:
        start = max(i for i in self.states if i <= n)
        r = self.states[start].copy()
        for i in range(start, n):
            k = min(i, self.most)
            g = 1 + (i - self.at[:k]) * r[:k]
            r[1:k] = r[: k - 1] * g[1:] / g[:-1]
            r[0] = g[0] / (i - self.discount)
            if (i + 1) % self.every == 0:
                self.states[i + 1] = r.copy()
        return r

    def _change(self, x: float, y: np.ndarray) -> np.ndarray:
        """d log r / d log n at n = exp(x), from the step between n - 1/2 and n + 1/2."""
        m = np.exp(x)

        def step(y: np.ndarray) -> np.ndarray:
            q = np.exp(-y) + (m - 0.5)
            return np.log((q - self.at) / (np.concatenate(([m - 0.5], q[:-1])) - self.at + self.discount))

        return m * step(y - 0.5 * step(y))

    def _integrated(self, n: int) -> np.ndarray:
        start, y = self.last if self.last and self.last[0] <= n else (self.limit, np.log(self._counted(self.limit)))
        # Strides that are stable for the steepest quotient, which only flattens.
        x = np.log(start)
        steps = int(np.ceil((np.log(n) - x) / min(0.05, 1.2 / (1 + np.exp(-y.min())))))
        h = (np.log(n) - x) / max(1, steps)
        for _ in range(steps):
            a = self._change(x, y)
            b = self._change(x + h / 2, y + h / 2 * a)
            c = self._change(x + h / 2, y + h / 2 * b)
            d = self._change(x + h, y + h * c)
            x, y = x + h, y + h / 6 * (a + 2 * b + 2 * c + d)
        self.last = (n, y)
        return np.exp(y)


@lru_cache(maxsize=12)
def seatings(discount: float, most: int) -> Seatings:
    """Kept between a worker's tasks."""
    return Seatings(discount, most)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma(x) by Stirling's series, from x = 1 on by way of x + 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 1 / (12 * y) - 1 / (360 * y**3)
    return series - sum(np.log(x + i) for i in range(8))


def log_seatings_wide(n: int, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(n, t) up to a number that depends on n alone, for many tables t: the saddle point of its generating function.

    S(n, t) is n! / t! times the coefficient of z ** n in ((1 - (1 - z) ** discount) / discount) ** t; z = 1 - exp(-s).
    """
    d, ratio = discount, np.log(n / t)
    s = np.maximum(ratio, 1e-3)
    for _ in range(60):
        e, f = -np.expm1(-s), -np.expm1(-d * s)
        value = np.log(e) + s * (1 - d) + np.log(d) - np.log(f) - ratio
        slope = (1 - e) / e + (1 - d) - d * (1 - f) / f
        step = np.clip(value / slope, -2, 0.7 * s)
        s = s - step
        if np.abs(step).max() < 1e-12 * (1 + s.max()):
            break
    e, f = -np.expm1(-s), -np.expm1(-d * s)
    slope = (1 - e) / e + (1 - d) - d * (1 - f) / f
    curve = e * np.exp(s) * (n / t) * slope
    return t * np.log(f / d) - _log_gamma(t + 1.0) - n * np.log(e) - 0.5 * np.log(t * curve)


def _draw_wide(n: int, first: float, growth: float, discount: float, x: float) -> int:
    """One number of tables of a dish that has hundreds: drawn in a window of 12 standard deviations about the mode."""

    def weight(t: np.ndarray) -> np.ndarray:
        return log_seatings_wide(n, t, discount) + t * np.log(growth) + _log_gamma(first / growth + t)

    lo, hi = 1, n - 1
    while hi - lo > 64:
        t = np.unique(np.linspace(lo, hi, 33).astype(np.int64)).astype(float)
        best = int(weight(t).argmax())
        lo, hi = int(t[max(0, best - 1)]), int(t[min(len(t) - 1, best + 1)])
    t = np.arange(lo, hi + 1.0)
    mode = int(t[weight(t).argmax()])
    step = max(1, int(0.02 * mode))
    around = weight(np.clip(np.array([mode - step, mode, mode + step], dtype=float), 1, n - 1))
    spread = step / np.sqrt(max(1e-12, 2 * around[1] - around[0] - around[2]))
    t = np.arange(max(1, int(mode - 12 * spread - 16)), min(n - 1, int(mode + 12 * spread + 16)) + 1.0)
    w = weight(t)
    total = np.cumsum(np.exp(w - w.max()))
    return int(t[np.searchsorted(total, x * total[-1], side="right").clip(0, len(t) - 1)])


def draw_tables(count: np.ndarray, others: np.ndarray, prob: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables (chains x dishes) of dishes of ``count`` customers, drawn given all other tables.

    others (chains x dishes): tables of the restaurant's other dishes; prob (chains x dishes): the parent's probability
    of the dish. t tables have a probability in proportion to S(count, t) * prob ** t * (strength + discount * others) *
    (strength + discount * (others + 1)) * ... of t factors: the conditional of a Gibbs step for all of a dish's customers at
    once. Numbers of tables of less than exp(-45) of the mode's probability are left out. Dishes that expect more than
    WIDE tables take S from its saddle point; from one t to the next that is off by 0.005 in log probability at a discount
    of 0.7 (by 0.09 at 0.95), which moves the tables of such a dish by a few in a hundred, and its customers' share by
    less than one in a thousand. A single customer always has one table.
    """
    out = np.ones(others.shape, dtype=np.int64)
    several = np.flatnonzero(count > 1)
    if not len(several):
        return out
    several = several[np.argsort(count[several], kind="stable")]
    groups = np.split(several, np.flatnonzero(np.diff(count[several])) + 1)
    new = prob * (strength + discount * others)
    for g in groups:
        n, p, first = int(count[g[0]]), np.maximum(prob[:, g].ravel(), 1e-300), np.maximum(new[:, g].ravel(), 1e-300)
        order = np.argsort(first, kind="stable") if n > 16 else np.arange(len(p))
        drawn, hi = np.empty(len(p), dtype=np.int64), len(p)
        x = rng.random(len(p))
        while hi and n > 2 * WIDE and first[order[hi - 1]] * np.log1p(n / first[order[hi - 1]]) > WIDE:
            hi -= 1
            i = order[hi]
            drawn[i] = _draw_wide(n, first[i], p[i] * discount, discount, x[i])
        expected = 1 + first[order[hi - 1]] * np.log1p(n / first[order[hi - 1]]) if hi else 0
        most = 256
        while most < min(n - 1, expected + 10 * np.sqrt(expected) + 32):
            most *= 2
        log_s = seatings(discount, most).log(n)
        while hi:
            # The largest first factor and the largest growth bound how far any of the rows reaches.
            lo = max(0, hi - max(1, min((1 << 18) // min(n, 64), hi)))
            own = order[lo:hi]
            reach = log_s + np.cumsum(np.log(first[own].max() + p[own].max() * discount * np.arange(len(log_s))))
            far = np.flatnonzero(reach > reach.max() - 45)[-1] + 1
            if far == len(log_s) < n:
                most *= 2
                log_s = seatings(discount, most).log(n)
                continue
            lo = max(lo, hi - max(1, (1 << 20) // far))
            own = order[lo:hi]
            weight = np.cumsum(np.log(first[own][:, None] + (p[own] * discount)[:, None] * np.arange(far)), axis=1) + log_s[:far]
            total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            drawn[own] = 1 + (total[:, :-1] <= (x[own] * total[:, -1])[:, None]).sum(axis=1)
            hi = lo
        out[:, g] = drawn.reshape(len(out), -1)
    return out


def parent_probability(customers: np.ndarray, seats: np.ndarray, facts: dict) -> np.ndarray:
    """Of words by chain (chains x words) in the parent; words without customers are unknown ones."""
    c, t = (np.array(facts[k], dtype=float)[:, None] for k in ("customers", "seats"))
    strength, discount = facts["strength"], facts["discount"]
    return (customers - discount * seats) / (strength + c) + (strength + discount * t) / (strength + c) * facts["base"]


# Packed arrays ----------------------------------------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Integers in as few bytes as they need (negative ones in eight), by significance, compressed: most high bytes are zeros."""
    a = np.ascontiguousarray(a).ravel()
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    size = 8 if low < 0 else next(n for n in (1, 2, 4, 8) if high < 1 << 8 * n)
    a = a.astype(f"u{size}")
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), size).T.tobytes())


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(b)[1:]), np.uint8), b[0]
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"u{size}").ravel().astype(kind)


def _pack_rising(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_rising(b: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(_unpack(b, kind), dtype=kind)


def _pack_pairs(pairs: np.ndarray) -> bytes:
    """Rising pairs: steps of the context above, the word itself below."""
    u = pairs >> np.uint64(32)
    return _pack(np.diff(u, prepend=np.uint64(0)) << np.uint64(32) | pairs & np.uint64(MOST_IDS - 1))


def _unpack_pairs(b: bytes) -> np.ndarray:
    x = _unpack(b, np.uint64)
    return np.cumsum(x >> np.uint64(32), dtype=np.uint64) << np.uint64(32) | x & np.uint64(MOST_IDS - 1)


def _split(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(MOST_IDS - 1)).astype(np.int64)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


class Rows:
    """Rows of a schema as Arrow tables; columns that a row doesn't name are null. ids: the type of a column of ids."""

    def __init__(self, schema: str, ids: DataType | None = None):
        kinds = _KINDS | ({"id": to_arrow_type(ids)} if ids else {})
        named = [c.split() for c in schema.split(", ")]
        self.schema = ", ".join(f"{c} {k.replace('id', ids.simpleString()) if ids and k in ('id', 'array<id>') else k}" for c, k in named)
        self.fields = pa.schema([(c, pa.list_(kinds[k[6:-1]]) if k.startswith("array<") else kinds[k]) for c, k in named])

    def table(self, rows: list[dict]) -> pa.Table:
        return pa.table([pa.array([r.get(f.name) for r in rows], f.type) for f in self.fields], names=self.fields.names)

    def map(self, df: DataFrame, make: Callable[[dict], Iterator[dict]]) -> DataFrame:
        """make(row) gives rows; at most 64 of them make a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = []
            for batch in batches:
                for i in range(batch.num_rows):
                    for row in make(batch.slice(i, 1).to_pylist()[0]):
                        out.append(row)
                        if len(out) == 64:
                            yield from self.table(out).to_batches()
                            out = []
            if out:
                yield from self.table(out).to_batches()

        return df.mapInArrow(run, self.schema)

    def group(self, df: DataFrame, by: str, make: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
        return df.groupBy(by).applyInArrow(lambda table: self.table(list(make(table.to_pylist()))), self.schema)

    def meet(self, df: DataFrame, more: DataFrame, by: str, make: Callable[[dict, list[dict]], Iterator[dict]]) -> DataFrame:
        """make(row, rows) for each row of df and the rows of more with the same key."""

        def run(one: pa.Table, many: pa.Table) -> pa.Table:
            return self.table(list(make(one.to_pylist()[0], many.to_pylist())) if one.num_rows else [])

        return df.groupBy(by).cogroup(more.groupBy(by)).applyInArrow(run, self.schema)


# Blocks -----------------------------------------------------------------------------------------------------------

BLOCK = "block long, size long, distinct long, words binary, order binary, counts binary, doc_ids array<id>, held array<boolean>, lengths binary, tokens binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """Documents (doc_id, text, held) coded as numbers of the block's own words in order of appearance (0: the end).

    words: their hashes, rising; order: the number of each; counts: its training tokens.
    """
    schema = Rows(BLOCK, rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        number = TaskContext.get().partitionId() << 24
        known = defaultdict(count(1).__next__)
        ids, held, codes, size = [], [], [], 0

        def block() -> pa.Table:
            lengths, tokens = np.array([len(c) for c in codes], dtype=np.int32), np.concatenate(codes)
            trained = np.repeat(~np.array(held, dtype=bool), lengths)
            hashes = np.fromiter([END, *(xxh3_64_intdigest(w) for w in known)], dtype=np.uint64, count=len(known) + 1)
            order = np.argsort(hashes, kind="stable")
            counts = np.bincount(tokens[trained], minlength=len(hashes))[order]
            row = {"block": number, "size": len(tokens), "distinct": len(hashes), "words": _pack_rising(hashes[order]), "order": _pack(order.astype(np.int32)), "counts": _pack(counts)}
            return schema.table([row | {"doc_ids": ids, "held": held, "lengths": _pack(lengths), "tokens": _pack(tokens)}])

        for batch in batches:
            for key, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().lower().split() if text else []
                own = np.zeros(len(words) + 1, dtype=np.int32)
                own[:-1] = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
                codes.append(own)
                ids.append(key)
                held.append(bool(out))
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield from block().to_batches()
                    number, known, ids, held, codes, size = number + 1, defaultdict(count(1).__next__), [], [], [], 0
        if ids:
            yield from block().to_batches()

    return rows.mapInArrow(run, schema.schema)


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Ranges of hashes, so that a block's rising words lie slice by slice."""
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _parts(of: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Where each number below n lies in a rising array."""
    ends = np.searchsorted(of, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(ends)).tolist():
        yield i, slice(int(ends[i]), int(ends[i + 1]))


WORDS = Rows("slice int, block long, words binary, counts binary")


def _post_words(slices: int):
    def make(row: dict) -> Iterator[dict]:
        words, counts = _unpack_rising(row["words"], np.uint64), _unpack(row["counts"])
        for i, part in _parts(_slice_of(words, slices), slices):
            yield {"slice": i, "block": row["block"], "words": _pack_rising(words[part]), "counts": _pack(counts[part])}

    return make


NUMBERED = Rows("slice int, block long, ids binary, n binary, distinct long, total long")


def _number(slices: int):
    """Ids of a slice's words that training has, frequent ones first: rank * slices + slice; -1 for the others."""

    def make(rows: list[dict]) -> Iterator[dict]:
        i = rows[0]["slice"]
        words = [_unpack_rising(r["words"], np.uint64) for r in rows]
        every, where = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([_unpack(r["counts"]) for r in rows]), minlength=len(every)).astype(np.int64)
        order = np.lexsort((every, -n))
        known = int((n > 0).sum())
        if known * slices >= MOST_IDS:
            raise ValueError("more than four billion distinct words")
        ids = np.full(len(every), -1, dtype=np.int64)
        ids[order[:known]] = np.arange(known) * slices + i
        yield {"slice": i, "n": _pack(n[order[:known]]), "distinct": known, "total": int(n.sum())}
        at = 0
        for r, own in zip(rows, words):
            yield {"slice": i, "block": r["block"], "ids": _pack(ids[where[at : at + len(own)]])}
            at += len(own)

    return make


def _in_order(row: dict, rows: list[dict], column: str) -> np.ndarray:
    """What the slices tell of a block's words, by the words' numbers in the block."""
    told = np.concatenate([_unpack(r[column]) for r in rows])
    order = _unpack(row["order"], np.int32)
    out = np.empty((len(told) // len(order), len(order)), dtype=np.int64)
    at = 0
    for r in rows:
        part = _unpack(r[column]).reshape(len(out), -1)
        out[:, order[at : at + part.shape[1]]] = part
        at += part.shape[1]
    return out


def _asked(ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, buckets: int):
    """The block's distinct pairs of known words in bucket order, rising within each; the bucket of each, and for every token
    where its pair is (their number: one of an unknown word)."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(lengths) - lengths] = 0
    u, w = ids[context], ids[tokens]
    known = (u >= 0) & (w >= 0)
    pairs, inverse = np.unique(u[known].astype(np.uint64) << np.uint64(32) | w[known].astype(np.uint64), return_inverse=True)
    h = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    of = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    place = np.empty(len(order) + 1, dtype=np.int64)
    place[order], place[-1] = np.arange(len(order)), len(order)
    at = np.full(len(tokens), len(order))
    at[known] = place[inverse]
    return pairs[order], of[order], at, context


POSTS = Rows("bucket long, block long, pairs binary, counts binary")


def _post_pairs(buckets: int):
    def make(row: dict, rows: list[dict]) -> Iterator[dict]:
        rows = sorted(rows, key=lambda r: r["slice"])
        lengths, tokens = _unpack(row["lengths"], np.int32), _unpack(row["tokens"], np.int32)
        pairs, of, at, _ = _asked(_in_order(row, rows, "ids")[0], lengths, tokens, buckets)
        trained = np.repeat(~np.array(row["held"], dtype=bool), lengths)
        counts = np.bincount(at[trained], minlength=len(pairs) + 1)
        for b, part in _parts(of, buckets):
            yield {"bucket": b, "block": row["block"], "pairs": _pack_pairs(pairs[part]), "counts": _pack(counts[part])}

    return make


# Buckets ----------------------------------------------------------------------------------------------------------

BUCKETS = Rows("bucket long, pairs binary, counts binary, ones long, twos long, blocks array<long>, places array<binary>")


def _merge(rows: list[dict]) -> Iterator[dict]:
    """The postings of a bucket as one list of distinct pairs, and for each block where its pairs are in it."""
    own = [_unpack_pairs(r["pairs"]) for r in rows]
    pairs, where = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([_unpack(r["counts"]) for r in rows]), minlength=len(pairs)).astype(np.int64)
    places = np.split(where, np.cumsum([len(x) for x in own])[:-1])
    yield {
        "bucket": rows[0]["bucket"], "pairs": _pack_pairs(pairs), "counts": _pack(counts), "ones": int((counts == 1).sum()), "twos": int((counts == 2).sum()),
        "blocks": [r["block"] for r in rows], "places": [_pack_rising(p) for p in places],
    }


def _several(row: dict, slices: int):
    """The bucket's pairs of two tokens or more: where they are, counts, their words slice by slice, and contexts and words as numbers of those."""
    pairs, counts = _unpack_pairs(row["pairs"]), _unpack(row["counts"])
    many = np.flatnonzero(counts > 1)
    u, w = _split(pairs[many])
    words, where = np.unique(np.concatenate((u, w)), return_inverse=True)
    of = words % slices
    order = np.argsort(of, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    where = place[where]
    return counts, many, words[order], of[order], where[: len(many)], where[len(many) :]


#: after, before: for each word, tables of pairs with it as context and as word; at first, tokens beyond each pair's first.
SEATED = Rows("slice int, bucket long, block long, ranks binary, after binary, before binary, tables binary, counts binary")


def _by_slice(bucket: int, words: np.ndarray, of: np.ndarray, slices: int, after: np.ndarray, before: np.ndarray) -> Iterator[dict]:
    for i, part in _parts(of, slices):
        yield {"slice": i, "bucket": bucket, "ranks": _pack_rising(words[part] // slices), "after": _pack(after[:, part]), "before": _pack(before[:, part])}


def _repeats(slices: int):
    """A word's distinct successors and predecessors are its tokens less these; words of single pairs need no row."""

    def make(row: dict) -> Iterator[dict]:
        counts, many, words, of, u, w = _several(row, slices)
        after, before = (np.bincount(x, weights=counts[many] - 1, minlength=len(words)).astype(np.int64)[None] for x in (u, w))
        yield from _by_slice(row["bucket"], words, of, slices, after, before)

    return make


def _seat_bucket(s: Settings, discount: float, slices: int, parent: dict, salt: int, answer: bool):
    """Seats a bucket's pairs in all chains. Tells the slices of tables beyond each pair's first, itself of all, and with
    ``answer`` the blocks of what they asked."""

    def make(row: dict, rows: list[dict]) -> Iterator[dict]:
        counts, many, words, of, u, w = _several(row, slices)
        facts = sorted((r for r in rows if r["slice"] is not None), key=lambda r: r["slice"])
        tables, customers, seats = (np.concatenate([np.empty((s.chains, 0), dtype=np.int64), *(_unpack(r[c]).reshape(s.chains, -1) for r in facts)], axis=1) for c in ("tables", "customers", "seats"))
        before = next((_unpack(r["own"]).reshape(s.chains, -1) for r in rows if r["own"] is not None), np.ones((s.chains, len(many)), dtype=np.int64))
        rng = np.random.default_rng([s.seed, 1, salt, row["bucket"]])
        now = draw_tables(counts[many], tables[:, u] - before, parent_probability(customers, seats, parent)[:, w], s.context_strength, discount, rng)
        sums = (np.array([np.bincount(x, weights=t - 1, minlength=len(words)) for t in now], dtype=np.int64) for x in (u, w))
        yield from _by_slice(row["bucket"], words, of, slices, *sums)
        if not answer:
            yield {"bucket": row["bucket"], "tables": _pack(now)}
            return
        total = np.minimum(counts, 1) * s.chains
        total[many] = now.sum(axis=0)
        for block, place in zip(row["blocks"], row["places"]):
            own = _unpack_rising(place)
            c = counts[own]
            yield {"bucket": row["bucket"], "block": block, "counts": _pack(c), "tables": _pack(total[own][c > 1])}

    return make


# Slices -----------------------------------------------------------------------------------------------------------

#: A row without bucket and block is the slice's state: first_after and first_before are its words' distinct successors and
#: predecessors, to which each chain adds the tables beyond a pair's first.
SLICES = Rows(
    "slice int, bucket long, block long, ids binary, n binary, first_after binary, first_before binary, tables binary, customers binary, seats binary, own binary, "
    "customer_sums array<long>, seat_sums array<long>, ones long, twos long"
)


def _start(chains: int):
    """State of a slice with each pair at one table."""

    def make(rows: list[dict]) -> Iterator[dict]:
        n = next(_unpack(r["n"]) for r in rows if r["n"] is not None)
        after, before = n.copy(), n.copy()
        for r in rows:
            if r["ranks"] is not None:
                ranks = _unpack_rising(r["ranks"])
                after[ranks] -= _unpack(r["after"])
                before[ranks] -= _unpack(r["before"])
        one = np.ones((chains, len(n)), dtype=np.int64)
        yield {"slice": rows[0]["slice"], "n": _pack(n), "first_after": _pack(after), "first_before": _pack(before), "seats": _pack(one), "ones": int((before == 1).sum()), "twos": int((before == 2).sum())}

    return make


def _seat_slice(s: Settings, slices: int, parent: dict, salt: int, first: bool):
    """Adds up what the buckets seated, seats the parent's customers and answers the buckets and blocks that have rows."""

    def make(rows: list[dict]) -> Iterator[dict]:
        state = next(r for r in rows if r["first_after"] is not None)
        n, after, before = (_unpack(state[c]) for c in ("n", "first_after", "first_before"))
        tables, customers = np.repeat(after[None], s.chains, axis=0), np.repeat(before[None], s.chains, axis=0)
        for r in rows if not first else ():
            if r["ranks"] is not None:
                ranks = _unpack_rising(r["ranks"])
                tables[:, ranks] += _unpack(r["after"]).reshape(s.chains, -1)
                customers[:, ranks] += _unpack(r["before"]).reshape(s.chains, -1)
        was = _unpack(state["seats"]).reshape(s.chains, -1)
        # Each chain has customers of its own, so all are dishes of one draw.
        others = np.array(parent["seats"])[:, None] - was
        rng = np.random.default_rng([s.seed, 2, salt, state["slice"]])
        seats = draw_tables(customers.ravel(), others.reshape(1, -1), np.full((1, was.size), parent["base"]), parent["strength"], parent["discount"], rng).reshape(was.shape)
        own = {k: state[k] for k in ("slice", "n", "first_after", "first_before")}
        yield own | {"seats": _pack(seats), "customer_sums": customers.sum(axis=1).tolist(), "seat_sums": seats.sum(axis=1).tolist()}
        for r in rows:
            if r["ranks"] is not None and r["bucket"] is not None:
                at = _unpack_rising(r["ranks"])
                yield {"slice": state["slice"], "bucket": r["bucket"], "tables": _pack(tables[:, at]), "customers": _pack(customers[:, at]), "seats": _pack(seats[:, at])}
            elif r["ids"] is not None:
                # Words of one token have one table and one customer, and unknown ones none: n alone tells.
                ids = _unpack(r["ids"])
                tokens = np.where(ids >= 0, np.append(n, 0)[ids // slices], 0)
                many = ids[tokens > 1] // slices
                yield {
                    "slice": state["slice"], "block": r["block"], "ids": r["ids"], "n": _pack(tokens),
                    "tables": _pack(tables[:, many]), "customers": _pack(customers[:, many]), "seats": _pack(seats[:, many]),
                }

    return make


# Scores -----------------------------------------------------------------------------------------------------------

def _score(schema: Rows, s: Settings, discount: float, buckets: int, parent: dict, n: int, v: int):
    def make(row: dict, rows: list[dict]) -> Iterator[dict]:
        by_slice = sorted((r for r in rows if r["slice"] is not None), key=lambda r: r["slice"])
        by_bucket = sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])
        lengths, tokens = _unpack(row["lengths"], np.int32), _unpack(row["tokens"], np.int32)
        ids, total = (_in_order(row, by_slice, c)[0] for c in ("ids", "n"))
        told = np.concatenate([_unpack(r["n"]) for r in by_slice])
        order = _unpack(row["order"], np.int32)
        tables, customers, seats = (np.repeat(np.minimum(total, 1)[None], s.chains, axis=0) for _ in range(3))
        for out, c in ((tables, "tables"), (customers, "customers"), (seats, "seats")):
            out[:, order[told > 1]] = np.concatenate([_unpack(r[c]).reshape(s.chains, -1) for r in by_slice], axis=1)
        _, _, at, context = _asked(ids, lengths, tokens, buckets)
        counts = np.concatenate([np.empty(0, dtype=np.int64), *(_unpack(r["counts"]) for r in by_bucket)])
        seated = np.minimum(counts, 1) * float(s.chains)
        seated[counts > 1] = np.concatenate([np.empty(0, dtype=np.int64), *(_unpack(r["tables"]) for r in by_bucket)])
        own = np.append(counts - discount * seated / s.chains, 0.0)
        parents, backs = parent_probability(customers, seats, parent), (s.context_strength + discount * tables) / (s.context_strength + total)
        # The chains' predictive probabilities, averaged; the part of the pair's own customers is linear in its tables.
        p = own[at] / (s.context_strength + total[context])
        for back, of_parent in zip(backs, parents):
            p += back[context] * of_parent[tokens] / s.chains
        first = np.cumsum(lengths) - lengths
        score = np.add.reduceat(np.log10(p), first)
        base = np.add.reduceat(np.log10((total[tokens] + 1) / (n + v + 1)), first)
        known = np.add.reduceat((total[tokens] > 0).astype(np.int64), first)
        cols = [row["doc_ids"], row["held"], lengths.astype(np.int64), known, base, score]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema.fields)], names=schema.fields.names)

    def run(one: pa.Table, many: pa.Table) -> pa.Table:
        return make(one.to_pylist()[0], many.to_pylist()) if one.num_rows else schema.table([])

    return run


def _ratio(ones: float, twos: float) -> float:
    """A discount from the numbers of counts of one and of two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))


def score_texts(docs: DataFrame, held_out, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    ``held_out``: a boolean column; the model learns from the other rows (null counts as not held out). Tokens
    are words (A-Z lower-cased) and one end for each text; an empty or null text is the end alone. score is the
    log10 probability of the text, the predictive averaged over chains; base_score is add-one unigram. Repeated
    rows and null ids are scored like any other row, other columns aren't read; an empty table gives no rows;
    without training rows every token is unknown. Very long texts make a block of their own. Discounts are
    estimated from counts of one and two; random numbers are drawn for parts in their own order, so a lost task
    repeats its result. Nothing is capped: all counts grow with the rows.
    """
    s, spark = settings, docs.sparkSession
    small_batches(spark)
    blocks = materialise(_blocks(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))), "blocks")
    # Rows are whole parts from here on: the bytes of a batch are what bounds it.
    small_batches(spark, 64)
    size, distinct = (int(x or 0) for x in blocks.agg(F.sum("size"), F.sum("distinct")).first())
    buckets, slices = max(8, -(-size // BUCKET_TOKENS)), max(4, -(-distinct // SLICE_WORDS))
    numbered = materialise(NUMBERED.group(WORDS.map(blocks.select("block", "words", "counts"), _post_words(slices)), "slice", _number(slices)), "numbered")
    v, n = (int(x or 0) for x in numbered.agg(F.sum("distinct"), F.sum("total")).first())
    ids = numbered.where("block is not null").select("slice", "block", "ids")
    texts = blocks.select("block", "order", "doc_ids", "held", "lengths", "tokens")
    posts = POSTS.meet(texts.drop("doc_ids"), ids, "block", _post_pairs(buckets))
    bucketed = materialise(BUCKETS.group(posts, "bucket", _merge), "buckets")
    slim = bucketed.select("bucket", "pairs", "counts")
    seated = materialise(SEATED.map(slim, _repeats(slices)), "seated")
    state = materialise(SLICES.group(numbered.where("n is not null").select("slice", "n").unionByName(seated, allowMissingColumns=True), "slice", _start(s.chains)), "state")
    discount, parent_discount = (_ratio(*(float(x or 0) for x in t.agg(F.sum("ones"), F.sum("twos")).first())) for t in (bucketed, state))
    # Sums by chain over all of the parent; seats are those that a word's own are left out of when it is seated anew.
    parent = {"base": 1.0 / (v + 1), "strength": s.parent_strength, "discount": parent_discount, "seats": [v] * s.chains, "customers": [0] * s.chains}
    sums = [F.sum(F.get(c, F.lit(i))) for c in ("customer_sums", "seat_sums") for i in range(s.chains)]
    for r in range(s.rounds + 1):
        last = r == s.rounds
        known = state.where("first_after is not null").select("slice", "n", "first_after", "first_before", "seats")
        rows = known.unionByName(seated.where("slice is not null").select("slice", "bucket", "ranks", "after", "before"), allowMissingColumns=True)
        rows = rows.unionByName(ids if last else ids.limit(0), allowMissingColumns=True)
        own = None if r == 0 else materialise(seated.where("slice is null and block is null").select("bucket", F.col("tables").alias("own")), "own")
        state = _replace([state] if last else [state, seated], SLICES.group(rows, "slice", _seat_slice(s, slices, parent, r, r == 0)), "state")
        told = [int(x or 0) for x in state.agg(*sums).first()]
        parent = parent | {"customers": told[: s.chains], "seats": told[s.chains :]}
        if not last:
            facts = state.where("bucket is not null").select("slice", "bucket", "tables", "customers", "seats")
            facts = facts.withColumn("own", F.lit(None).cast("binary")) if own is None else facts.unionByName(own, allowMissingColumns=True)
            final = r == s.rounds - 1
            seated = SEATED.meet(bucketed if final else slim, facts, "bucket", _seat_bucket(s, discount, slices, parent, r, final))
            seated = _replace([own] if own is not None else [], seated, "seated")
    told = state.where("block is not null").select("block", "slice", "ids", "n", "tables", "customers", "seats")
    told = told.unionByName(seated.where("block is not null").select("block", "bucket", "tables", "counts"), allowMissingColumns=True)
    for old in (numbered, bucketed):
        forget(old)
    schema = Rows("doc_id id, held_out boolean, n_tokens long, n_known long, base_score double, score double", docs.schema["doc_id"].dataType)
    score = _score(schema, s, discount, buckets, parent, n, v)
    scored = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema.schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _replace(old: list[DataFrame], new: DataFrame, name: str) -> DataFrame:
    """new as a scratch table; the old ones, which nothing else reads, are deleted."""
    new = materialise(new, name)
    for df in old:
        forget(df)
    return new
