"""Language of each word by a linear-chain conditional random field, and of each text by its words."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Words that are labelled at once of each text; longer texts go on from there, so a text is one chain whatever its length.
SEGMENT = 2048
#: Hashed features.
FEATURES = 1 << 16
#: Words times labels of the chains that are computed at once, but for a longer text, and of remembered scores.
CELLS, KEPT_CELLS = 4_000_000, 20_000_000


class Training(NamedTuple):
    """texts: whole labelled texts of each language at most, of lowest hash; words: of a language in all, from the
    same texts, at most; chain: words of a training chain; switched: further chains made of runs of several languages'
    texts, from which the moves between languages are learnt; lexicon: entries for each language; labels: languages that
    a model has room for, beyond which learning fails: no language is left out."""

    texts: int = 200
    words: int = 150_000
    chain: int = 256
    switched: int = 400
    lexicon: int = 3000
    labels: int = 400
    steps: int = 60
    rate: float = 0.1
    decay: float = 1e-4


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    moves: np.ndarray  # labels x labels
    lexicon: dict[str, int]  # word -> bits of the languages that list it


def word_key(word: str) -> str:
    """A word in lower case without signs at its ends; '' if no letter is left."""
    if not word.isalpha():
        lo, hi = 0, len(word)
        while lo < hi and not word[lo].isalpha():
            lo += 1
        while hi > lo and not word[hi - 1].isalpha():
            hi -= 1
        word = word[lo:hi]
    return word.lower()


def features(keys: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affixes, character n-grams and lexicon entries of word keys, each once a key: all of them, and how many each key has.

    A key is marked at both ends, so that n-grams of up to three tell short affixes, too; one longer prefix and two longer
    suffixes are added.
    """
    marked = np.frombuffer("".join(f"^{k}$" for k in keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)) + 2
    owner = np.repeat(np.arange(len(keys)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(marked)) - start[owner]
    left = size[owner] - at
    grams = [np.zeros(len(marked), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, 6):
            code = np.concatenate((marked[n - 1 :], np.zeros(min(n - 1, len(marked)), dtype=np.uint64)))
            h = (grams[-1] ^ (code + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
            grams.append(h ^ (h >> np.uint64(29)))
    full = size[owner] > 2
    wanted = [(1, full), (2, full & (left >= 2)), (3, full & (left >= 3)), (4, full & ((at == 0) & (left >= 4) | (left == 4))), (5, full & (left == 5))]
    value = lambda h: (h >> np.uint64(16)).astype(np.int64) % (FEATURES - 1) + 1
    found = [owner[w] * FEATURES + value(grams[n][w]) for n, w in wanted]
    # Which languages list a key, and how many; few sets of languages make up all of them.
    sets: dict[int, int] = {}
    of = np.fromiter((sets.setdefault(lexicon.get(k, 0), len(sets)) for k in keys), dtype=np.int64, count=len(keys))
    for listed, i in sets.items():
        names = [n for n in range(listed.bit_length()) if listed >> n & 1]
        marks = [crc32(f"L{x}".encode()) % (FEATURES - 1) + 1 for x in (*names, f"{len(names) or 'none'}#")]
        own = np.flatnonzero((of == i) & (size > 2))
        found.append(np.repeat(own * FEATURES, len(marks)) + np.tile(np.array(marks), len(own)))
    found.append(np.flatnonzero(size == 2) * FEATURES)
    every = np.sort(np.concatenate(found))
    every = every[np.diff(every, prepend=-1) > 0]
    return every % FEATURES, np.bincount(every // FEATURES, minlength=len(keys))


def posteriors(scores: np.ndarray, rows: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = SEGMENT, pairs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, their posteriors over labels) by forward-backward over whole texts, all at once; the last segment comes first.

    Word i of all texts in order has the scores ``scores[rows[i]]``. Texts are sorted by length, so the ith words of those
    that have one lie together and nothing is padded. Only a segment of each text is held; the forward pass keeps
    its state at the segments' beginnings and is taken again from there. ``pairs`` (for texts within one segment): the
    expected numbers of moves are added to it.
    """
    order = np.argsort(-lengths, kind="stable")
    size, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with a word at each place
    m = np.exp(moves)

    def forward(lo: int, before: np.ndarray | None):
        n = alive[lo : lo + segment]
        ends = np.cumsum(n)
        rank = np.arange(ends[-1]) - np.repeat(ends - n, n)
        words = first[rank] + np.repeat(np.arange(lo, lo + len(n)), n)
        e = scores[rows[words]]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = np.empty_like(e)
        for t, (end, k) in enumerate(zip(ends.tolist(), n.tolist())):
            now = e[end - k : end] if before is None else (before[:k] @ m) * e[end - k : end]
            before = np.divide(now, now.sum(axis=1, keepdims=True), out=alpha[end - k : end])
        return words, e, alpha, ends.tolist(), n.tolist(), rank

    starts = range(0, int(size[0]), segment)
    carried: list[np.ndarray | None] = [None]
    for lo in starts[:-1]:
        _, _, alpha, ends, n, _ = forward(lo, carried[-1])
        carried.append(alpha[ends[-1] - n[-1] :].copy())
    after = None  # emission times beta of the word behind
    for lo, before in zip(reversed(starts), reversed(carried)):
        words, e, alpha, ends, n, rank = forward(lo, before)
        beta = np.ones_like(e)
        for end, k in zip(reversed(ends), reversed(n)):
            own = beta[end - k : end]
            if after is not None:
                b = after @ m.T
                np.divide(b, b.sum(axis=1, keepdims=True), out=own[: len(b)])
            after = e[end - k : end] * own
        if pairs is not None and len(n) > 1:
            inside = np.arange(n[0], len(words))
            was, then = alpha[inside - np.repeat(n[:-1], n[1:])], e[inside] * beta[inside]
            pairs += m * ((was / ((was @ m) * then).sum(axis=1, keepdims=True)).T @ then)
        alpha *= beta
        alpha /= alpha.sum(axis=1, keepdims=True)
        yield words, alpha


class Emissions:
    """Scores of word keys for each label, remembered for ``most`` words at most."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, min(most, KEPT_CELLS // max(1, len(model.labels)))
        self.columns = np.ascontiguousarray(model.weights.T)
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.of_key: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.model.labels)))
        self.lettered = np.zeros(1024, dtype=bool)

    def rows(self, words: list[str]) -> np.ndarray:
        """Where each word's scores are."""
        number, of_key = self.number, self.of_key
        if new := list(set(words).difference(number)):
            own = [word_key(w) for w in new]
            if keys := list(set(own).difference(of_key)):
                values = np.empty((len(keys), len(self.model.labels)))
                for lo in range(0, len(keys), 20_000):
                    flat, size = features(keys[lo : lo + 20_000], self.model.lexicon)
                    cut = np.cumsum(size) - size
                    for j in range(values.shape[1]):
                        values[lo : lo + 20_000, j] = np.add.reduceat(self.columns[j][flat], cut)
                n = len(of_key)
                while n + len(keys) > len(self.scores):
                    self.scores, self.lettered = (np.concatenate((x, np.zeros_like(x))) for x in (self.scores, self.lettered))
                self.scores[n : n + len(keys)], self.lettered[n : n + len(keys)] = values, [bool(k) for k in keys]
                of_key.update(zip(keys, range(n, n + len(keys))))
            number.update(zip(new, map(of_key.__getitem__, own)))
        return np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))

    def tidy(self):
        if len(self.number) > self.most:
            self.clear()


def fit(texts: list[tuple[str, str]], t: Training) -> Model:
    """Gradient ascent on the conditional likelihood of the words' labels; texts: (lang, text)."""
    labels = sorted({lang for lang, _ in texts})
    of = {x: i for i, x in enumerate(labels)}
    seen: list[dict[str, int]] = [{} for _ in labels]
    for lang, text in texts:
        c = seen[of[lang]]
        for w in text.split():
            if k := word_key(w):
                c[k] = c.get(k, 0) + 1
    lexicon: dict[str, int] = {}
    for i, c in enumerate(seen):
        for w in sorted((w for w in c if c[w] > 1), key=lambda w: (-c[w], w))[: t.lexicon]:
            lexicon[w] = lexicon.get(w, 0) | 1 << i
    model = Model(labels, np.zeros((FEATURES, len(labels))), np.zeros((len(labels), len(labels))), lexicon)
    room = {x: t.words for x in labels}
    words, lengths, gold, known = [], [], [], {}
    pool = []
    for lang, text in texts:
        own = [known.setdefault(w, w) for w in text.split()]
        if own and room[lang] > 0:
            room[lang] -= len(own)
            pool.append((of[lang], own))
            for lo in range(0, len(own), t.chain):
                part = own[lo : lo + t.chain]
                words += part
                gold += [of[lang]] * len(part)
                lengths.append(len(part))
    if len(labels) < 2 or not words:
        return model
    draw = np.random.default_rng(len(pool))
    by_label = [[own for k, own in pool if k == i] for i in range(len(labels))]
    spoken = [i for i, own in enumerate(by_label) if own]
    for _ in range(t.switched):
        n = len(words)
        for i in draw.choice(spoken, size=int(draw.integers(2, 6))).tolist():
            own = by_label[i][int(draw.integers(len(by_label[i])))]
            at = int(draw.integers(len(own)))
            part = own[at : at + int(draw.integers(3, 25))]
            words += part
            gold += [i] * len(part)
        lengths.append(len(words) - n)
    lengths, gold = np.array(lengths), np.array(gold)
    types, of_word = np.unique(np.array(words, dtype=object), return_inverse=True)
    flat, size = features([word_key(w) for w in types], lexicon)
    at = np.cumsum(size) - size
    n, k = len(words), len(labels)
    ends = np.cumsum(lengths)
    follows = np.ones(n, dtype=bool)
    follows[ends - lengths] = False
    kept = np.zeros((k, k))
    np.add.at(kept, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1.0)
    # Parts are whole chains, so that what a step holds beside the weights doesn't grow with the labels.
    part = (ends - lengths) * k // CELLS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    parts = [(lengths[lo:hi], slice(int(ends[lo] - lengths[lo]), int(ends[hi - 1]))) for lo, hi in zip(cuts, cuts[1:])]
    sums_w, sums_m = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8)
    for _ in range(t.steps):
        slope, pairs = np.zeros_like(model.weights), np.zeros_like(model.moves)
        for own_lengths, where in parts:
            own, of_own = np.unique(of_word[where], return_inverse=True)
            many = size[own]
            first = np.cumsum(many) - many
            listed = flat[np.repeat(at[own] - first, many) + np.arange(many.sum())]
            scores = np.stack([np.add.reduceat(model.weights[listed, j], first) for j in range(k)], axis=1)
            expected = np.empty((len(of_own), k))
            for at_words, found in posteriors(scores, of_own, own_lengths, model.moves, t.chain + 25 * 6, pairs):
                expected[at_words] = found
            owner = np.repeat(np.arange(len(own)), many)
            for j in range(k):
                by_type = np.bincount(of_own[gold[where] == j], minlength=len(own)) - np.bincount(of_own, weights=expected[:, j], minlength=len(own))
                slope[:, j] += np.bincount(listed, weights=by_type[owner], minlength=FEATURES)
        slope /= n
        slope -= t.decay * model.weights
        turn = (kept - pairs) / n - t.decay * model.moves
        sums_w += slope**2
        sums_m += turn**2
        slope *= t.rate
        slope /= np.sqrt(sums_w)
        model.weights[:] += slope
        model.moves[:] += t.rate * turn / np.sqrt(sums_m)
    return model


def _slim(model: Model) -> Model:
    return model._replace(weights=model.weights.astype(np.float32))


def sample_labelled(docs: DataFrame, t: Training) -> DataFrame:
    """(lang, text, n): the ``texts`` rows of lowest hash for each language; docs (doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null")
    counts = known.groupBy("lang").count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.join(F.broadcast(counts), "lang").withColumn("share", share).where(F.col("share") * F.col("count") <= 2 * t.texts + 20)
    order = Window.partitionBy("lang").orderBy("share", "doc_id", "text")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= t.texts).select("lang", "text", "n")


def learn(docs: DataFrame, learn_from: Column, training: Training = Training()) -> Model:
    """A model of the languages of docs (doc_id, text, lang), from a bounded sample of the rows where ``learn_from`` holds.

    Every language takes part. The sample is fitted in one task, which holds texts * labels texts at most and takes time
    with the square of the labels; the driver gets the weights alone, FEATURES * labels single-precision numbers. More languages than
    ``training.labels`` raise a ValueError, as the weights would outgrow a task.
    """
    known = docs.where(learn_from).where("lang is not null and text is not null")
    if (n := known.select("lang").distinct().limit(training.labels + 1).count()) > training.labels:
        raise ValueError(f"more than {training.labels} languages in lang ({n} counted at least); a model has room for Training.labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_slim(fit(texts, training)))], pa.binary())], ["model"])

    rows = sample_labelled(docs.where(learn_from).select("doc_id", "text", "lang"), training)
    made = rows.repartition(1).sortWithinPartitions("lang", "n").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], training)


def _label(texts: list[str | None], emissions: Emissions, runs: bool = False):
    """Label number (the last stands for ``und``) and score of each text, the runs of its word labels if wanted, and how sure
    its words are: the mean of each lettered word's highest posterior, whatever its language; 0 without a letter."""
    model, k = emissions.model, len(emissions.model.labels)
    split = [x.split() if x else [] for x in texts]
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    if len(texts) > 1 and lengths.sum() * k > CELLS:
        half = len(texts) // 2
        (a, b, c, d), (e, f, g, h) = _label(texts[:half], emissions, runs), _label(texts[half:], emissions, runs)
        return np.concatenate((a, e)), np.concatenate((b, f)), c + g, np.concatenate((d, h))
    emissions.tidy()
    best, score, found, sure = np.full(len(split), k), np.zeros(len(split)), [[] for _ in split], np.zeros(len(split))
    full = np.flatnonzero(lengths)
    if len(full) and k:
        rows = emissions.rows([w for x in split for w in x])
        own, lettered = lengths[full], emissions.lettered[rows]
        text_of = np.repeat(np.arange(len(full)), own)
        sums, doubt, label = np.zeros((len(full), k)), np.zeros(len(full)), np.empty(len(rows), dtype=np.int32) if runs else None
        for words, posterior in posteriors(emissions.scores, rows, own, model.moves):
            weighed, texts_of = lettered[words].astype(float), text_of[words]
            for j in range(k):
                sums[:, j] += np.bincount(texts_of, weights=posterior[:, j] * weighed, minlength=len(full))
            doubt += np.bincount(texts_of, weights=posterior.max(axis=1) * weighed, minlength=len(full))
            if runs:
                label[words] = posterior.argmax(axis=1)
        n = np.bincount(text_of, weights=lettered, minlength=len(full))
        best[full] = np.where(n > 0, sums.argmax(axis=1), k)
        score[full] = np.clip(np.where(n > 0, sums.max(axis=1) / np.maximum(n, 1), 0.0), 0, 1)
        sure[full] = np.clip(doubt / np.maximum(n, 1), 0, 1)
        if runs:
            first = np.cumsum(own) - own
            for i, lo, size in zip(full, first, own):
                bounds = [0, *(np.flatnonzero(np.diff(label[lo : lo + size])) + 1).tolist(), int(size)]
                found[i] = [{"lang": model.labels[label[lo + a]], "words": b - a} for a, b in zip(bounds, bounds[1:])]
    return best, score, found, sure


def identify(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score), one row for each input row; one narrow pass.

    Each word gets a posterior for every language by forward-backward; lang_pred has the largest sum over words
    with a letter, score is its mean posterior there. A text that is null or has no letter gets ``und`` and score
    0; so does every text if there was nothing to learn from. A whole text is one chain, however long. Ties go to the
    label that sorts first; an empty table gives no rows.
    With ``runs``, a column runs lists (lang, words) of equal word labels in order, for code-switched text.
    Repeated rows get equal results; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        names = np.array([*shared.value.labels, "und"], dtype=object)
        for batch in batches:
            best, score, found, _ = _label(batch.column(1).to_pylist(), emissions, runs)
            cols = [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)]
            if runs:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "runs"][: len(cols)])

    more = ", runs array<struct<lang:string,words:int>>" if runs else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double{more}")


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of docs, with all columns, whose text has a letter and words of whose languages the model is sure.

    The mean over words with a letter of each one's highest posterior, whatever its language, is ``least`` at least;
    so a text in several languages stays if its words are told apart. A model without labels has no doubts: then all
    texts with a letter stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(shared.value)
        k = len(shared.value.labels)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if k:
                best, _, _, sure = _label(texts, emissions)
                yield batch.filter(pa.array((best < k) & (sure >= least)))
            else:
                yield batch.filter(pa.array([any(word_key(w) for w in (x or "").split()) for x in texts], pa.bool_()))

    # Names of any kind go by places.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
