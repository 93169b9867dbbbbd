"""A robust-pruned directed graph over the vectors of one shard.

Vectors enter in batches that at most double the graph. For a batch, greedy
beam searches propose neighbours, robust pruning keeps diverse ones (a
candidate goes if a kept neighbour is nearer to it by the factor alpha than the
vector itself is), and the edges are also laid backwards. All steps run on
whole batches in numpy; a search is a beam search from the most central vector.
"""

from __future__ import annotations

import numpy as np

#: Queries that move through the graph together.
BATCH = 512


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Graph:
    """Neighbour lists over distinct vectors; see build().

    degree: edges that pruning keeps (lists may hold twice as many until they
    are pruned again); beam: width of the searches while building; expand: nodes
    of the beam that are opened at once; trace: nodes passed on the way that are
    prune candidates besides the beam.
    """

    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 16, alpha: float = 1.2, expand: int = 4, trace: int = 16):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.degree, self.room, self.beam, self.alpha, self.expand, self.trace = degree, 2 * degree, beam, alpha, expand, trace
        self.out = np.full((n, self.room), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        self.start = int(_square(self.x, self.x.mean(0)).argmin()) if n else 0

    def build(self, seed: int = 7) -> "Graph":
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate(([self.start], order[order != self.start])) if n else order
        done = 1
        while done < n:
            batch = order[done : done + min(BATCH, max(1, done))]
            self._insert(batch)
            done += len(batch)
        return self

    def _insert(self, batch: np.ndarray) -> None:
        found, dist, passed = self.search(self.x[batch], self.beam, trace=True)
        far = np.where(passed >= 0, _square(self.x[passed], self.x[batch][:, None]), np.inf).astype(np.float32)
        kept = self._prune(batch, np.concatenate((found, passed), 1), np.concatenate((dist, far), 1))
        self.out[batch, : self.degree] = kept
        self.count[batch] = (kept >= 0).sum(1)
        at, slot = np.nonzero(kept >= 0)
        self._backwards(kept[at, slot], batch[at])

    def _backwards(self, to: np.ndarray, source: np.ndarray) -> None:
        """Add the edges to -> source; lists that overflow are pruned."""
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, new = np.unique(to, return_index=True, return_counts=True)
        fits = self.count[nodes] + new <= self.room
        rank = np.arange(len(to)) - np.repeat(first, new)
        easy = np.repeat(fits, new)
        self.out[to[easy], self.count[to[easy]] + rank[easy]] = source[easy]
        self.count[nodes[fits]] += new[fits]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(new[full], kind="stable")]
        while len(full):
            wide = new[full] <= max(32, 2 * new[full[0]])
            some, full = full[wide][:BATCH], np.concatenate((full[wide][BATCH:], full[~wide]))
            width = int(new[some].max())
            more = np.full((len(some), width), -1, np.int32)
            for_row = np.repeat(np.arange(len(some)), new[some])
            col = np.arange(len(for_row)) - np.repeat(np.cumsum(new[some]) - new[some], new[some])
            more[for_row, col] = source[np.repeat(first[some], new[some]) + col]
            v = nodes[some]
            cand = np.concatenate((self.out[v], more), 1)
            dist = np.where(cand >= 0, _square(self.x[cand], self.x[v][:, None]), np.inf).astype(np.float32)
            kept = self._prune(v, cand, dist)
            self.out[v] = -1
            self.out[v, : self.degree] = kept
            self.count[v] = (kept >= 0).sum(1)

    def _prune(self, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse neighbours of each node, nearest first; -1 fills up."""
        dist = np.where((cand < 0) | (cand == nodes[:, None]), np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        alive = np.isfinite(dist)
        v = self.x[cand]
        rows = np.arange(len(nodes))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        relaxed = np.float32(self.alpha**2)
        for k in range(self.degree):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[some, k] = cand[rows, pick][some]
            alive &= relaxed * _square(v, v[rows, pick][:, None]) > dist
            alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, beam: int, trace: bool = False) -> tuple:
        """(ids, squared distances) of the beam of each query, nearest first; with trace also nodes passed."""
        q = np.ascontiguousarray(queries, np.float32)
        parts = [self._walk(q[i : i + BATCH], beam, trace) for i in range(0, len(q), BATCH)]
        if not parts:
            return np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32), np.zeros((0, 0), np.int32)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _walk(self, q: np.ndarray, beam: int, trace: bool) -> tuple:
        b, n = len(q), len(self.x)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], dist[:, 0], open_[:, 0] = self.start, _square(self.x[self.start], q), True
        seen, tag = np.zeros(b * n, bool), np.empty(b * n, np.int32)
        seen[np.arange(b) * n + self.start] = True
        passed = np.full((b, self.trace if trace else 0), -1, np.int32)
        filled, live = 0, np.arange(b)
        while len(live):
            e = min(self.expand, beam)
            ahead = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(ahead, e - 1, axis=1)[:, :e]
            ok = np.isfinite(np.take_along_axis(ahead, pick, 1))
            if not ok.any():
                break
            go = ok.any(1)
            live, pick, ok = live[go], pick[go], ok[go]
            node = np.where(ok, np.take_along_axis(ids[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            if trace and filled < passed.shape[1]:
                w = min(e, passed.shape[1] - filled)
                passed[live, filled : filled + w] = node[:, :w]
                filled += w
            near = np.where(node[:, :, None] >= 0, self.out[node], -1).reshape(len(live), -1)
            row, col = np.nonzero(near >= 0)
            near = near[row, col]
            key = live[row] * n + near
            new = ~seen[key]
            row, near, key = row[new], near[new], key[new]
            seen[key] = True
            mark = np.arange(len(key), dtype=np.int32)
            tag[key] = mark
            once = tag[key] == mark
            row, near = row[once], near[once]
            some = np.bincount(row, minlength=len(live))
            slot = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
            d = np.full((len(live), beam + int(some.max(initial=0))), np.inf, np.float32)
            node = np.full(d.shape, -1, np.int32)
            fresh = np.zeros(d.shape, bool)
            d[:, :beam], node[:, :beam], fresh[:, :beam] = dist[live], ids[live], open_[live]
            at = row, beam + slot
            d[at], node[at], fresh[at] = _square(self.x[near], q[live[row]]), near, True
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            ids[live], open_[live], dist[live] = (np.take_along_axis(v, best, 1) for v in (node, fresh, d))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), passed


class ShardIndex:
    """The graph of a shard of vectors in which equal vectors are one node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, **settings):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.asarray(x, np.float64)[order]
        self.x, group = np.unique(x, axis=0, return_inverse=True) if len(x) else (x, np.zeros(0, np.int64))
        by = np.argsort(group, kind="stable")
        self.ids = ids[by]
        self.first = np.searchsorted(group[by], np.arange(len(self.x) + 1))
        self.graph = Graph(self.x, **settings).build()

    def stored(self) -> tuple[int, int, bytes, bytes, bytes, bytes, bytes]:
        """(dimensions, start, ids, vectors, first id of each node, edges of each node, edges) to write down; see load()."""
        g = self.graph
        edges = g.out[g.out >= 0]
        return self.x.shape[1], g.start, self.ids.tobytes(), self.x.tobytes(), self.first.tobytes(), (g.out >= 0).sum(1).astype(np.uint8).tobytes(), edges.tobytes()

    @classmethod
    def load(cls, dims: int, start: int, ids: bytes, x: bytes, first: bytes, count: bytes, edges: bytes) -> "ShardIndex":
        self = cls.__new__(cls)
        self.ids, self.first = np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
        self.x = np.frombuffer(x, np.float64).reshape(-1, dims)
        self.graph = g = Graph(self.x[:0])
        n = np.frombuffer(count, np.uint8).astype(np.int64)
        g.x, g.start = np.ascontiguousarray(self.x, np.float32), start
        g.out = np.full((len(self.x), int(n.max(initial=1))), -1, np.int32)
        g.out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.frombuffer(edges, np.int32)
        return self

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, squared distance) of the k nearest of each query but itself; ties by id."""
        if not len(self.x) or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        node = self.graph.search(q, beam)[0]
        row = np.repeat(np.arange(len(q)), node.shape[1])
        node = node.ravel()
        row, node = row[node >= 0], node[node >= 0]
        d = np.round(_square(self.x[node], np.asarray(q, np.float64)[row]), 10)
        size = np.minimum(self.first[node + 1] - self.first[node], k + 1)
        at = np.repeat(self.first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        row, d, found = np.repeat(row, size), np.repeat(d, size), self.ids[at]
        other = found != own[row]
        row, d, found = row[other], d[other], found[other]
        order = np.lexsort((found, d, row))
        row, d, found = row[order], d[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        return row[rank < k], found[rank < k], d[rank < k]
