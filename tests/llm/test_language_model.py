"""The language model's seating and scores against plain versions."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, lm, queries


def _log_seatings(n, d):
    """log S(n, t) for t from 0 on, customer by customer."""
    t = np.arange(n + 1)
    log_s = np.where(t == 1, 0.0, -np.inf)
    for seated in range(1, n):
        log_s = np.logaddexp(log_s + np.log(np.maximum(seated - d * t, 1e-300)), np.concatenate(([-np.inf], log_s[:-1])))
    return log_s


@pytest.mark.parametrize("discount", [0.05, 0.5, 0.9])
def test_integrated_steps_equal_single_ones(discount, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 200)
    own = lm.Seatings(discount, 40)
    for n in (3, 3000, 90, 500, 3000, 2):
        want = _log_seatings(n, discount)[1:42]
        assert np.allclose(own.log(n), (want - want[0])[: min(n, 41)], atol=1e-4)


@pytest.mark.parametrize("discount, off", [(0.1, 1e-3), (0.5, 5e-3), (0.7, 1e-2)])
def test_saddle_points_follow_the_recursion(discount, off):
    t = np.arange(100.0, 400.0)
    assert np.allclose(np.diff(lm.log_seatings_wide(2000, t, discount)), np.diff(_log_seatings(2000, discount)[100:400]), atol=off)


@pytest.mark.parametrize("wide", [1000, 60])
def test_drawn_tables_follow_the_conditional(wide, monkeypatch):
    """Mean and spread of the tables of dishes, against the conditional written out; with a lower bound for saddle points, too."""
    monkeypatch.setattr(lm, "WIDE", wide)
    d, strength, chains = 0.3, 2.0, 4
    cases = [(1, 3, 0.2), (2, 0, 0.4), (5, 40, 0.01), (30, 3, 0.001), (500, 10, 0.6), (2000, 400, 0.3)]
    count, others, prob = (np.tile(x, 1000) for x in map(np.array, zip(*cases)))
    got = lm.draw_tables(count, np.tile(others, (chains, 1)), np.tile(prob, (chains, 1)), strength, d, np.random.default_rng(5))
    assert (got >= 1).all() and (got <= count).all()
    for i, (n, o, p) in enumerate(cases):
        t = np.arange(1, n + 1)
        log_p = _log_seatings(n, d)[1:] + t * math.log(p) + np.cumsum(np.log(strength + d * (o + t - 1)))
        w = np.exp(log_p - log_p.max())
        w /= w.sum()
        mean = (w * t).sum()
        sd = math.sqrt((w * (t - mean) ** 2).sum())
        own = got[:, i :: len(cases)]
        assert own.mean() == pytest.approx(mean, abs=5 * sd / math.sqrt(own.size) + 1e-9) and own.std() == pytest.approx(sd, rel=0.1, abs=0.03)


class _Sequential:
    """The model seated customer by customer, one chain: plain Gibbs moves over explicit tables."""

    def __init__(self, pairs, v, d, dp, s):
        self.pairs, self.d, self.dp, self.s, self.base = pairs, d, dp, s, 1 / (v + 1)
        self.tables = collections.defaultdict(list)  # (context, word) -> sizes
        self.parent = collections.defaultdict(list)  # word -> sizes
        self.n, self.t, self.r = collections.Counter(), collections.Counter(), random.Random(3)
        for p in pairs:
            self.sit(p)

    def parent_p(self, w):
        own = self.parent[w]
        c, t = sum(map(sum, self.parent.values())), sum(map(len, self.parent.values()))
        return (sum(own) - self.dp * len(own) + (self.s.parent_strength + self.dp * t) * self.base) / (self.s.parent_strength + c)

    def p(self, u, w):
        own = self.tables[u, w]
        return (sum(own) - self.d * len(own) + (self.s.context_strength + self.d * self.t[u]) * self.parent_p(w)) / (self.s.context_strength + self.n[u])

    def _join(self, sizes, discount, new):
        i = self.r.choices(range(len(sizes) + 1), [x - discount for x in sizes] + [new])[0]
        if i == len(sizes):
            sizes.append(0)
        sizes[i] += 1
        return i == len(sizes) - 1 and sizes[i] == 1

    def _leave(self, sizes):
        i = self.r.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def sit(self, p):
        u, w = p
        if self._join(self.tables[p], self.d, (self.s.context_strength + self.d * self.t[u]) * self.parent_p(w)):
            self.t[u] += 1
            t = sum(map(len, self.parent.values()))
            self._join(self.parent[w], self.dp, (self.s.parent_strength + self.dp * t) * self.base)
        self.n[u] += 1

    def move(self, p):
        self.n[p[0]] -= 1
        if self._leave(self.tables[p]):
            self.t[p[0]] -= 1
            self._leave(self.parent[p[1]])
        self.sit(p)


def test_scores_equal_a_sequential_sampler(spark):
    """Scores of held-out texts, against the average predictive of a sampler that moves one customer at a time."""
    r = random.Random(1)
    words = ["a", "b", "c", "d", "e", "f"]
    text = lambda: " ".join(r.choices(words, [30, 12, 6, 3, 2, 1])[0] for _ in range(r.randint(3, 9)))
    train, probe = [text() for _ in range(60)], [text() for _ in range(12)] + ["", "zz a", "f f f f"]
    rows = spark.createDataFrame([(i, x, i >= len(train)) for i, x in enumerate([*train, *probe])], "doc_id long, text string, held boolean")
    s = lm.Settings(rounds=8, chains=24)
    got = {r.doc_id: r.score for r in lm.score_texts(rows, F.col("held"), s).where("held_out").collect()}
    tokens = lambda x: list(zip(["", *x.split()], [*x.split(), ""]))
    pairs = [p for x in train for p in tokens(x)]
    counts = collections.Counter(pairs)
    before = collections.Counter(w for _, w in counts)
    d, dp = (lm._ratio(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in (counts, before))
    model = _Sequential(pairs, len({w for _, w in pairs}), d, dp, s)
    sums, draws = collections.Counter(), 30
    asked = {p for x in probe for p in tokens(x)}
    for sweep in range(10 + draws):
        for p in pairs:
            model.move(p)
        if sweep >= 10:
            for p in asked:
                sums[p] += model.p(*p) / draws
    for i, x in enumerate(probe):
        want = sum(math.log10(sums[p]) for p in tokens(x))
        assert got[len(train) + i] == pytest.approx(want, rel=0.02, abs=0.03)


def test_query_columns(spark, sf):
    """The registered query: the split by crc32, and scores that a second run repeats."""
    out = queries.op1_hpyp_lm(spark, sf)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (common.crc_mod("doc_id", 7) == 2).alias("held"))
    rows = {r.doc_id: r for r in out.collect()}
    assert {d: r.held_out for d, r in rows.items()} == {r.doc_id: r.held for r in held.collect()}
    assert {r.doc_id: r.score for r in queries.op1_hpyp_lm(spark, sf).collect()} == {d: r.score for d, r in rows.items()}
