"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, as flat neighbour arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .vectors import matrix, search

#: Links of a node (twice as many in the lowest layer, and there also TOPS of largest inner product and ROOM for repairs), candidates
#: that they are chosen of, nodes kept in a search of the lowest layer and of the others, nodes opened in a step, and inserted in a lot.
LINKS, TOPS, ROOM, CANDIDATES, BEAM, UPPER, OPENED, TOGETHER = 16, 12, 4, 64, 96, 32, 8, 2048
GRAPH = "points binary, firsts binary, ids binary, levels binary, links array<binary>"


def lifted(points: np.ndarray) -> np.ndarray:
    """One more component makes all norms equal, so that nearness in the graph orders like inner products with queries."""
    norms = (points**2).sum(axis=1)
    return np.concatenate((points, np.sqrt(np.maximum(0, norms.max() - norms))[:, None]), axis=1)


def _descend(points: np.ndarray, half: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer by all queries together: the ``beam`` best nodes of each and their scores, best first.

    A node's score is its inner product with the query less ``half`` of it. starts (queries x any; -1: none) are open at first;
    each step opens the best unopened nodes of every query, which is done when all that it keeps are opened.
    """
    n, nq = len(points), len(queries)
    seen = np.zeros((nq, n + 1), dtype=bool)
    seen[:, n] = True  # what -1 stands for
    # What is kept: nodes, scores (-inf: none) and whether they were opened.
    kept, value, done = np.full((nq, beam), -1), np.full((nq, beam), -np.inf), np.ones((nq, beam), dtype=bool)
    active, near = np.arange(nq), starts
    while len(active):
        near = np.sort(near, axis=1)
        fresh = ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[active[:, None], near] = True
        score = np.where(fresh, np.einsum("nld,nd->nl", points[near], queries[active]) - half[near], -np.inf)
        both = np.concatenate((value[active], score), axis=1)
        top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        value[active] = np.take_along_axis(both, top, axis=1)
        kept[active] = np.take_along_axis(np.concatenate((kept[active], np.where(fresh, near, -1)), axis=1), top, axis=1)
        done[active] = np.take_along_axis(np.concatenate((done[active], ~fresh), axis=1), top, axis=1)
        open_value = np.where(done[active], -np.inf, value[active])
        j = np.argpartition(-open_value, min(OPENED, beam) - 1, axis=1)[:, :OPENED]
        live = np.take_along_axis(open_value, j, axis=1) > -np.inf
        some = live.any(axis=1)
        active, j, live = active[some], j[some], live[some]
        done[active[:, None], j] = True
        near = np.where(live[:, :, None], links[kept[active[:, None], j]], -1).reshape(len(active), j.shape[1] * links.shape[1])
    order = np.argsort(-value, axis=1, kind="stable")
    value = np.take_along_axis(value, order, axis=1)
    return np.where(value > -np.inf, np.take_along_axis(kept, order, axis=1), -1), value


def _diverse(points: np.ndarray, of: np.ndarray, near: np.ndarray, room: int) -> np.ndarray:
    """For each point ``of``, up to ``room`` of its candidates ``near`` (-1: none): first those that are nearer to it than to any
    chosen before, then the nearest others."""
    near = np.sort(near, axis=1)
    x = points[near]
    squares = (x**2).sum(axis=2)
    gap = squares - 2 * np.matmul(x, points[of][:, :, None])[:, :, 0] + (points[of] ** 2).sum(axis=1)[:, None]
    none = (near < 0) | (near == of[:, None])
    none[:, 1:] |= near[:, 1:] == near[:, :-1]
    gap = np.where(none, np.inf, gap)
    between = squares[:, :, None] + squares[:, None] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    rows, taken, closest = np.arange(len(of)), np.zeros(near.shape, dtype=bool), np.full(near.shape, np.inf)
    for _ in range(room):
        free = np.where(~taken & (gap < closest), gap, np.inf)
        pick = free.argmin(axis=1)
        ok = np.isfinite(free[rows, pick])
        if not ok.any():
            break
        taken[rows[ok], pick[ok]] = True
        closest = np.where(ok[:, None], np.minimum(closest, between[rows, pick]), closest)
    order = np.argsort(np.where(taken, -np.inf, gap), axis=1, kind="stable")[:, :room]
    out = np.where(np.isfinite(np.take_along_axis(gap, order, axis=1)), np.take_along_axis(near, order, axis=1), -1)
    return np.pad(out, ((0, 0), (0, room - out.shape[1])), constant_values=-1)


def _link(points: np.ndarray, links: np.ndarray, new: np.ndarray, near: np.ndarray, room: int) -> None:
    """Links new nodes to the diverse ones of their candidates, and those back: where the room is used up, they choose anew."""
    for lo in range(0, len(new), 512):
        links[new[lo : lo + 512], :room] = _diverse(points, new[lo : lo + 512], near[lo : lo + 512], room)
    a, b = np.repeat(new, room), links[new, :room].ravel()
    a, b = a[b >= 0], b[b >= 0]
    # Of many links back, the shortest.
    gap = np.concatenate([((points[a[i : i + 8192]] - points[b[i : i + 8192]]) ** 2).sum(axis=1) for i in range(0, max(1, len(a)), 8192)])
    order = np.lexsort((gap, b))
    a, b = a[order], b[order]
    few = np.arange(len(b)) - np.searchsorted(b, b) < CANDIDATES
    a, b = a[few], b[few]
    to, first, n = np.unique(b, return_index=True, return_counts=True)
    back = np.full((len(to), n.max(initial=0)), -1)
    back[np.repeat(np.arange(len(to)), n), np.arange(len(b)) - np.repeat(first, n)] = a
    # Nodes with few links back first, so that their rows are narrow.
    order = np.argsort(n, kind="stable")
    for lo in range(0, len(to), 512):
        part = order[lo : lo + 512]
        own = to[part]
        links[own, :room] = _diverse(points, own, np.concatenate((links[own, :room], back[part, : n[part].max()]), axis=1), room)


def _reached(links: np.ndarray, seen: np.ndarray, front: np.ndarray) -> None:
    while len(front):
        seen[front] = True
        near = np.unique(links[front])
        front = near[(near >= 0) & ~seen[near]]


def _repair(points: np.ndarray, links: np.ndarray, start: int) -> None:
    """Makes every node reachable from ``start``: nodes that aren't get a link, in the room kept for that, from a neighbour that is, or
    from the nearest node that is."""
    seen = np.zeros(len(points), dtype=bool)
    _reached(links, seen, np.array([start]))
    first = links.shape[1] - ROOM
    while not seen.all():
        lost = np.flatnonzero(~seen)
        full = (links[:, first:] >= 0).all(axis=1)
        good = (links[lost] >= 0) & seen[links[lost]] & ~full[links[lost]]
        some = good.any(axis=1)
        if some.any():
            lost = lost[some]
            near, which = np.unique(links[lost, good[some].argmax(axis=1)], return_index=True)
            lost = lost[which]
        else:
            there = np.flatnonzero(seen & ~full)
            there = there if len(there) else np.flatnonzero(seen)
            lost = lost[:1]
            near = there[[((points[there] - points[lost]) ** 2).sum(axis=1).argmin()]]
            links[lost, first] = near
        links[near, first + np.minimum((links[near, first:] >= 0).sum(axis=1), ROOM - 1)] = lost
        _reached(links, seen, lost)


def build_graph(points: np.ndarray, seed: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Top level of each node, drawn as usual, and the neighbours of each layer from the lowest on.

    Nodes are inserted in random order, in lots that double: each is linked in each of its layers to diverse ones of the
    nearest nodes there, and those back. A shard is so small that comparing a lot with all nodes so far, in one matrix
    product, takes less time than searching the graph for them, and misses none. In the lowest layer each node also links to
    those of largest inner product with it, as long vectors are what queries look for; then islands are linked.
    """
    n, draw = len(points), np.random.default_rng(seed + len(points))
    level = np.minimum(8, np.floor(-np.log(1 - draw.random(n)) / np.log(LINKS))).astype(np.int64)
    points = points.astype(np.float32)
    squares = (points**2).sum(axis=1)
    layers = [np.full((n, 2 * LINKS + TOPS + ROOM if l == 0 else LINKS), -1, dtype=np.int32) for l in range(int(level.max()) + 1)]
    order = draw.permutation(n)
    for l, links in enumerate(layers):
        here, at = order[level[order] >= l], 0
        while at < len(here):
            lot = here[at : at + max(32, min(TOGETHER, at))]
            at += len(lot)
            near = np.empty((len(lot), min(CANDIDATES, at)), dtype=np.int64)
            for lo in range(0, len(lot), 512):
                new = lot[lo : lo + 512]
                gap = squares[here[:at]] - 2 * points[new] @ points[here[:at]].T
                near[lo : lo + 512] = here[np.argpartition(gap, near.shape[1] - 1, axis=1)[:, : near.shape[1]]]
            _link(points, links, lot, near, LINKS * (2 if l == 0 else 1))
    # The last component of lifted points only makes norms equal.
    m = min(TOPS, n - 1)
    for lo in range(0, n if m else 0, 512):
        product = points[lo : lo + 512, :-1] @ points[:, :-1].T
        product[np.arange(len(product)), lo + np.arange(len(product))] = -np.inf
        layers[0][lo : lo + 512, 2 * LINKS : 2 * LINKS + m] = np.argpartition(-product, m - 1, axis=1)[:, :m]
    _repair(points, layers[0], int(level.argmax()))
    return level, layers


def search_graph(points: np.ndarray, level: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """The beam best nodes (queries x beam, -1: none) by inner product; all queries step together.

    Upper layers are walked with a beam, too, and all that it keeps enters the layer below, so that queries enter several parts
    of a layer that falls into clusters.
    """
    points, queries = points.astype(np.float32), queries.astype(np.float32)
    none = np.zeros(len(points), dtype=np.float32)
    starts = np.repeat(np.flatnonzero(level == level.max())[None, :UPPER], len(queries), axis=0)
    for links in layers[:0:-1]:
        starts, _ = _descend(points, none, links, queries, starts, UPPER)
    return _descend(points, none, layers[0], queries, starts, beam)[0]


def _build(key, table: pa.Table) -> pa.Table:
    """A node for each distinct vector, with the ids of all rows that have it in ascending order."""
    ids, v = table.column("vec_id").to_numpy(), matrix(table.column("v"))
    points, node = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    firsts = np.searchsorted(node.ravel()[order], np.arange(len(points) + 1))
    level, layers = build_graph(lifted(points))
    row = [key[0].as_py(), key[1].as_py(), points.tobytes(), firsts.tobytes(), ids[order].tobytes(), level.tobytes(), [x.tobytes() for x in layers]]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.binary())]
    return pa.table([pa.array([x], t) for x, t in zip(row, types)], names=["width", "shard", "points", "firsts", "ids", "levels", "links"])


def _probe(k: int, beam: int):
    def probe(row: dict, query_ids: np.ndarray, v: np.ndarray, floors: np.ndarray):
        firsts, ids, level = (np.frombuffer(row[c], np.int64) for c in ("firsts", "ids", "levels"))
        points = np.frombuffer(row["points"], float).reshape(len(level), -1)
        layers = [np.frombuffer(x, np.int32).reshape(len(level), -1) for x in row["links"]]
        found = search_graph(points, level, layers, v, max(beam, k + 1))
        at, node = np.nonzero(found >= 0)
        node = found[at, node]
        score = np.einsum("nd,nd->n", points[node], v[at])
        # A node's rows all have the same score; of them only the k + 1 of smallest id can be among k nearest.
        n = np.minimum(firsts[node + 1] - firsts[node], k + 1)
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, score, own = np.repeat(at, n), np.repeat(score, n), ids[np.repeat(firsts[node], n) + each]
        other = own != query_ids[at]
        at, score, own = at[other], score[other], own[other]
        order = np.lexsort((own, -score, at))
        at, score, own = at[order], score[order], own[order]
        # Of rows that repeat an id, the best.
        _, first = np.unique(np.stack((at, own)), axis=1, return_index=True)
        first.sort()
        at, score, own = at[first], score[first], own[first]
        top = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[top], own[top], score[top]

    return probe


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, beam: int = BEAM) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score double): about the k largest inner products of each query.

    Every row is indexed: rows of equal vectors share a node. Each shard's graph is searched from its top node
    down, with a beam of ``beam`` in the lowest layer; shards' results are merged. Ties go to smaller vec_ids.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, as rows of null vec_id.
    Rows that repeat a vec_id are one candidate, which counts with its best score, and one query, which takes the
    best of its vectors. Graphs hold single-precision copies, scores are of the vectors themselves; components
    beyond about 1e18 have no useful order in them. An empty table gives no rows; other columns aren't read.
    """
    return search(vectors, is_query, k, _build, _probe(k, beam), GRAPH, False, "double")
