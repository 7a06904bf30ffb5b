"""Exact largest inner products by branch and bound over ball trees, one for each shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .vectors import matrix, search

LEAF = 64
TREE = "depth int, ids binary, points binary, centres binary, radii binary"


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component) as doubles, which hold integers below 2 ** 53 exactly; what overflows is held to the largest double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max)


def build_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A complete binary tree of 2 ** depth leaves as arrays: the points' order, and centre and radius of each node.

    A node's points are halved at the median of their positions along the line between two far points, so equal
    points fall evenly to both sides. Node i has the children 2 i + 1 and 2 i + 2; leaf j holds the jth of
    2 ** depth parts of the order, as numpy.array_split would cut it level by level.
    """
    order = np.arange(len(points))
    centres, radii = np.zeros((2 ** (depth + 1) - 1, points.shape[1])), np.zeros(2 ** (depth + 1) - 1)
    bounds = [(0, len(points))]
    node = 0
    for level in range(depth + 1):
        nxt = []
        for lo, hi in bounds:
            own = points[order[lo:hi]]
            if len(own):
                centres[node] = own.mean(axis=0)
                away = ((own - centres[node]) ** 2).sum(axis=1)
                radii[node] = np.sqrt(away.max())
                if level < depth:
                    a = own[away.argmax()]
                    b = own[((own - a) ** 2).sum(axis=1).argmax()]
                    order[lo:hi] = order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
            mid = (lo + hi) // 2
            nxt += [(lo, mid), (mid, hi)]
            node += 1
        bounds = nxt
    return order, centres, radii


def _bounds(n: int, depth: int) -> np.ndarray:
    cuts = [(0, n)]
    for _ in range(depth):
        cuts = [x for lo, hi in cuts for x in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
    return np.array([lo for lo, _ in cuts] + [n])


def _build(scale: int):
    def build(key, table: pa.Table) -> pa.Table:
        points = quantised(matrix(table.column("v")), scale)
        depth = max(0, int(np.ceil(np.log2(max(1, len(points) / LEAF)))))
        with np.errstate(over="ignore", invalid="ignore"):
            order, centres, radii = build_tree(points, depth)
        ids = table.column("vec_id").to_numpy()[order]
        row = [key[0].as_py(), key[1].as_py(), depth, ids.tobytes(), points[order].tobytes(), centres.tobytes(), radii.tobytes()]
        types = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([x], t) for x, t in zip(row, types)], names=["width", "shard", "depth", "ids", "points", "centres", "radii"])

    return build


#: Scores are held to this, one less than a long holds; what is below stands for none.
MOST = (1 << 63) - 1
NONE = -MOST - 1


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while their sums stay below 2 ** 53, else in Python's integers, held to the range of a long."""
    if q.size and p.size and np.abs(q).max() * np.abs(p).max() * q.shape[1] >= 2**53:
        exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in p], dtype=object).T
        return np.clip(exact, -MOST, MOST).astype(np.int64)
    return (q @ p.T).astype(np.int64)


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """Marks each row's first place of an id."""
    order = np.argsort(ids, axis=1, kind="stable")
    own = np.take_along_axis(ids, order, axis=1)
    new = np.concatenate((np.ones((len(ids), 1), dtype=bool), own[:, 1:] != own[:, :-1]), axis=1)
    out = np.empty_like(new)
    np.put_along_axis(out, order, new, axis=1)
    return out


def _probe(k: int, scale: int):
    def probe(row: dict, query_ids: np.ndarray, v: np.ndarray, floors: np.ndarray):
        q = quantised(v, scale)
        ids = np.frombuffer(row["ids"], np.int64)
        points = np.frombuffer(row["points"], float).reshape(len(ids), -1)
        centres = np.frombuffer(row["centres"], float).reshape(-1, points.shape[1])
        radii, depth = np.frombuffer(row["radii"], float), row["depth"]
        bounds, repeats = _bounds(len(ids), depth), len(np.unique(ids)) < len(ids)
        norms = np.sqrt((q**2).sum(axis=1))
        kth = floors.copy()
        scores, found = np.full((len(q), k), NONE, dtype=np.int64), np.full((len(q), k), MOST, dtype=np.int64)

        def limits() -> np.ndarray:
            """No point of a node has a larger product; a little is added for what doubles round off. Beyond doubles there is no bound."""
            top = q @ centres.T + norms[:, None] * radii
            top = top + 1e-9 * (np.abs(top) + norms[:, None] * (np.sqrt((centres**2).sum(axis=1)) + radii)) + 1e-9
            return np.where(np.isfinite(top), top, np.inf)

        def first_leaves() -> np.ndarray:
            """The leaf that each query comes to first, at the child of larger bound all the way; -1 where its bound is too low."""
            node = np.zeros(len(q), dtype=int)
            for _ in range(depth):
                left = 2 * node + 1
                node = left + (most[every, left] < most[every, left + 1])
            return np.where(most[every, node] >= kth, node, -1)

        def look(node: int, who: np.ndarray) -> None:
            """Compares these queries with all points of a leaf."""
            leaf = node - (2**depth - 1)
            own = ids[bounds[leaf] : bounds[leaf + 1]]
            products = _products(q[who], points[bounds[leaf] : bounds[leaf + 1]])
            products[own == query_ids[who][:, None]] = NONE
            some = (products >= np.maximum(kth[who], -float(MOST))[:, None]).any(axis=1)
            who, products = who[some], products[some]
            if not len(who):
                return
            both, names = np.concatenate((scores[who], products), axis=1), np.concatenate((found[who], np.broadcast_to(own, products.shape)), axis=1)
            order = np.lexsort((names, ~both), axis=-1)
            both, names = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
            if repeats:
                both = np.where(_first_of_each(np.where(both > NONE, names, MOST)), both, NONE)
                order = np.lexsort((names, ~both), axis=-1)
                both, names = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
            scores[who], found[who] = both[:, :k], np.where(both > NONE, names, MOST)[:, :k]
            last = scores[who, k - 1]
            kth[who] = np.where(last > NONE, np.maximum(kth[who], last), kth[who])

        def visit(node: int, level: int, who: np.ndarray) -> None:
            who = who[most[who, node] >= kth[who]]
            if not len(who):
                return
            if level == depth:
                who = who[first[who] != node]
                if len(who):
                    look(node, who)
                return
            left, right = 2 * node + 1, 2 * node + 2
            if 2 * np.count_nonzero(most[who, left] >= most[who, right]) < len(who):
                left, right = right, left
            visit(left, level + 1, who)
            visit(right, level + 1, who)

        every = np.arange(len(q))
        with np.errstate(over="ignore", invalid="ignore"):
            most = limits()
            first = first_leaves()
            for node in np.unique(first[first >= 0]):
                look(node, np.nonzero(first == node)[0])
            visit(0, 0, every)
        at, place = np.nonzero(scores > NONE)
        return at, found[at, place], scores[at, place]

    return probe


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score long): each query's k largest integer inner products.

    Components become floor(scale * x). ``is_query``: a condition on vec_id. Each shard's ball tree is descended
    depth first by the queries of a block at once. Each query first goes to a leaf by the child of its larger upper
    bound; then all go through the rest together, at a node to the child first whose bound is larger for most of those left there,
    so that a leaf is compared once with all queries that need it. A query leaves a branch
    when its bound is below the kth score so far, which starts at the best that earlier lots of shards gave. Ties go
    to smaller vec_ids. Vectors that are null, empty or hold null or non-finite components take no part, as rows
    of null vec_id; zero vectors do. Scores beyond a long are held to its range. Rows that repeat a vec_id are one
    candidate, which counts with its best score, and one query, which takes the best of its vectors. An empty table
    gives no rows; other columns aren't read.
    """
    return search(vectors, is_query, k, _build(scale), _probe(k, scale), TREE, True, "long", waves=True)
