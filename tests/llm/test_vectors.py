"""The two vector searches on clusters, repeated ids, huge components and as registered queries."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import balltree, hnsw, queries, vectors


def _recall(v, asked, k=20):
    level, layers = hnsw.build_graph(hnsw.lifted(v))
    found = np.concatenate([hnsw.search_graph(v, level, layers, v[asked[i : i + 256]], hnsw.BEAM) for i in range(0, len(asked), 256)])
    out = []
    for q, f in zip(asked, found):
        s = v @ v[q]
        s[q] = -np.inf
        f = f[(f >= 0) & (f != q)]
        out.append((np.sort(s[f])[-k:] >= np.sort(s)[-k] - 1e-9).sum() / k)
    return np.array(out)


@pytest.mark.parametrize("clusters, size", [(80, 100), (40, 200), (20, 400), (1000, 8), (4000, 1)])
def test_recall_on_clusters(clusters, size):
    """Clusters around what a node's links hold are no islands; also plain and long-tailed Gaussians."""
    r = np.random.default_rng(clusters)
    v = (r.normal(size=(clusters, 1, 64)) + 0.1 * r.normal(size=(clusters, size, 64))).reshape(-1, 64)
    if size == 1:
        v[::2] *= np.exp(0.5 * r.normal(size=(clusters // 2, 1)))
    found = _recall(v, r.choice(len(v), 300, replace=False))
    assert found.mean() >= 0.95 and found.min() >= 0.5


def test_every_node_is_reached():
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(3, 5))[:, None] * 50 + 0.01 * r.normal(size=(3, 300, 5))]).reshape(-1, 5)
    level, layers = hnsw.build_graph(hnsw.lifted(v))
    seen = np.zeros(len(v), dtype=bool)
    hnsw._reached(layers[0], seen, np.array([int(level.argmax())]))
    assert seen.all()


def _exact(rows, queries_, k, scale):
    most = np.finfo(float).max
    q = lambda x: int(max(-most, min(most, np.floor(scale * x))))
    out = {}
    for name in queries_:
        best = {}
        for _, a in (r for r in rows if r[0] == name):
            for i, b in rows:
                if i != name and len(a) == len(b):
                    s = max(-balltree.MOST, min(balltree.MOST, sum(q(x) * q(y) for x, y in zip(a, b))))
                    best[i] = max(best.get(i, s), s)
        out[name] = sorted(((i, s) for i, s in best.items()), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_repeated_ids_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 16)
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(size=3)]) for i in r.integers(0, 40, size=120)] + [(50, [1e300, 1.0, 0.0]), (51, [1.7e308, -1.0, 0.0]), (52, [1e-300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 10, 20, 50, 51]
    want = _exact(rows, asked, 5, 256)
    got = collections.defaultdict(list)
    for x in balltree.exact_top_k(df, F.col("vec_id").isin(asked)).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert dict(got) == want
    two = spark.createDataFrame([(0, [1e306]), (1, [1e306])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in balltree.exact_top_k(two, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1, balltree.MOST), (1, 1, 0, balltree.MOST)]
    near = [tuple(x) for x in hnsw.nearest(df.where("vec_id < 50"), F.col("vec_id") == 10, k=5).orderBy("rank").collect()]
    assert len({x[2] for x in near}) == 5 and [x[1] for x in near] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("clusters", [0, 40])
def test_tree_compares_whole_blocks_with_leaves(monkeypatch, clusters):
    """Where no branch can be left, a leaf is compared with its first queries and with the rest, not with each group of equal paths; scores, ties and floors are those of brute force."""
    calls, pairs, own = [], [], balltree._products
    monkeypatch.setattr(balltree, "_products", lambda q, p: (calls.append(1), pairs.append(len(q) * len(p)), own(q, p))[-1])
    r = np.random.default_rng(6)
    v = r.normal(size=(4000, 32))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    if clusters:
        v = 5 * v[:clusters, None] + 0.05 * v.reshape(clusters, -1, 32)
        v = v.reshape(-1, 32)
    v[1000:1100] = v[:100]  # ties
    ids = r.permutation(len(v)).astype(np.int64)
    table = pa.table({"vec_id": ids, "v": pa.array(list(v))})
    row = balltree._build(256)((pa.scalar(32), pa.scalar(0)), table).to_pylist()[0]
    w, leaves = np.floor(256 * v), 2 ** row["depth"]
    asked = np.arange(0, 4000, 16)
    s = (w[asked] @ w.T).astype(np.int64)
    s[np.arange(len(asked)), asked] = balltree.NONE
    want = [[(int(ids[j]), int(x[j])) for j in np.lexsort((ids, ~x))[:5]] for x in s]
    for floors in (np.full(len(asked), -np.inf), np.array([x[2][1] for x in want], dtype=float)):
        calls.clear(), pairs.clear()
        at, found, scores = balltree._probe(5, 256)(row, ids[asked], v[asked], floors)
        for i, x in enumerate(want):
            got = [(int(n), int(c)) for n, c in zip(found[at == i], scores[at == i]) if c >= floors[i]]
            assert got == [y for y in x if y[1] >= floors[i]]
        assert len(calls) <= 2 * leaves
        if clusters:
            assert sum(pairs) < 0.3 * len(asked) * len(v)


def test_registered_queries(spark, sf):
    """op3 equals brute force; op7 has the right columns, ranks, scores and recall."""
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    got = collections.defaultdict(list)
    for r in queries.op3_ball_tree(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    w = np.floor(256 * v)
    for q in ids[ids % 50 == 0]:
        s = (w @ w[ids == q][0]).astype(int)
        assert got[q] == sorted(((int(i), int(x)) for i, x in zip(ids, s) if i != q), key=lambda x: (-x[1], x[0]))[:5]
    out = queries.op7_hnsw(spark, sf).orderBy("query_id", "rank").collect()
    assert out[0].__fields__ == ["query_id", "rank", "vec_id", "score"]
    hits = 0
    for q in ids[ids % 20 == 0]:
        own = [r for r in out if r.query_id == q]
        s = v @ v[ids == q][0]
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.score == pytest.approx(s[ids == r.vec_id][0], abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & {int(i) for i in sorted(ids[ids != q], key=lambda i: (-s[ids == i][0], i))[:20]})
    assert hits >= 0.95 * 20 * (ids % 20 == 0).sum()
