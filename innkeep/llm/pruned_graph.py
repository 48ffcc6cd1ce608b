"""A robust-pruned directed graph over one shard's vectors, in numpy.

Points are inserted in batches that double in size: a greedy beam search from
the entry point proposes neighbours, and pruning keeps a proposed point only if
no kept one is, relaxed by ``ALPHA``, nearer to it than the new point is; so the
edges kept point in different directions.  Edges are made both ways, and a
point with too many of them is pruned again; parts that pruning cuts off get entries of
their own.  Largest inner product is nearest
neighbour search once each vector has one more coordinate that brings all to
the same length, with 0 there in queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, BUILD_BEAM, ALPHA, BATCH = 32, 64, 1.2, 256
SLACK = 16                # edges a point may have beyond DEGREE before it is pruned again
WIDE = 4                  # points of a beam expanded together
SEEN_CELLS = 8_000_000    # cells (query, point) noted at a time
_NONE = np.int32(-1)


@dataclass
class Graph:
    points: np.ndarray       # [n, d + 1] float32, of one length; the centre is not subtracted
    edges: np.ndarray        # [n, DEGREE + SLACK] int32, -1 where there is none
    entries: np.ndarray      # int32: every point can be reached from one of them

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, squared distance) of the ``beam`` nearest found for each
        query, nearest first; -1 and inf fill up.  With ``beam`` points or
        fewer, all are found."""
        step = max(16, SEEN_CELLS // max(1, len(self.points)))
        parts = [self._search_some(queries[lo:lo + step], beam) for lo in range(0, len(queries), step)]
        if not parts:
            return np.full((0, beam), _NONE), np.full((0, beam), np.inf, np.float32)
        return np.concatenate([i for i, _ in parts]), np.concatenate([d for _, d in parts])

    def _search_some(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, total = len(queries), len(self.points)
        seen, slot = np.zeros(n * total, bool), np.empty(n * total, np.int32)
        ids, dist = np.full((n, beam), _NONE), np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)

        def offer(rows: np.ndarray, near: np.ndarray) -> None:
            """Points not seen before compete for the beams of ``rows``."""
            cell = rows[:, None].astype(np.int64) * total + near
            at = np.flatnonzero((near >= 0) & ~seen[np.where(near >= 0, cell, 0)])
            cell, number = cell.reshape(-1)[at], np.arange(len(at), dtype=np.int32)
            slot[cell] = number                              # of a point met twice the last writer stays
            last = slot[cell] == number
            at, cell = at[last], cell[last]
            seen[cell] = True
            gap = self.points[near.reshape(-1)[at]] - queries[rows[at // near.shape[1]]]
            d = np.full(near.shape, np.inf, np.float32)
            d.reshape(-1)[at] = np.einsum("nd,nd->n", gap, gap)
            all_d = np.concatenate([dist[rows], d], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[rows] = np.take_along_axis(all_d, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), keep, 1)
            done[rows] = np.take_along_axis(np.concatenate([done[rows], np.isinf(d)], axis=1), keep, 1)

        rows = np.arange(n)
        for lo in range(0, len(self.entries), beam):
            offer(rows, np.tile(self.entries[lo:lo + beam], (n, 1)))
        wide = min(WIDE, beam)
        while len(rows := rows[~done[rows].all(axis=1)]):
            ahead = np.where(done[rows], np.inf, dist[rows])         # the nearest points not yet expanded
            spot = np.argpartition(ahead, wide - 1, axis=1)[:, :wide]
            open_ = np.isfinite(np.take_along_axis(ahead, spot, 1))
            expand = np.where(open_, ids[rows[:, None], spot], 0)
            done[rows[:, None], spot] = True
            near = np.where(open_[:, :, None], self.edges[expand], _NONE)
            offer(rows, near.reshape(len(rows), -1))
        order = np.lexsort((ids, dist), axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.where(np.isinf(dist), _NONE, ids), dist

    def _reach(self) -> np.ndarray:
        """Entries from which every point can be reached: the first one, and
        one in each part that edges from the entries before do not lead to."""
        reached, entries, unmet = np.zeros(len(self.points), bool), [], 0
        new = self.entries[:1]
        while len(new):
            entries.append(int(new[0]))
            reached[new] = True
            while len(new):
                near = np.unique(self.edges[new])
                near = near[near >= 0]
                new = near[~reached[near]]
                reached[new] = True
            left = np.flatnonzero(~reached[unmet:])
            new = left[:1] + unmet
            unmet = int(new[0]) if len(new) else unmet
        return np.array(entries, np.int32)

    def _prune(self, of: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Robust pruning of proposed points (-1: none, no repeats) to at most
        ``DEGREE`` edges."""
        gap = self.points[proposed] - self.points[of][:, None, :]
        d = np.where((proposed >= 0) & (proposed != of[:, None]), np.einsum("ncd,ncd->nc", gap, gap), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        d, proposed = np.take_along_axis(d, order, 1), np.take_along_axis(proposed, order, 1)
        x = self.points[proposed]
        norm = np.einsum("ncd,ncd->nc", x, x)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        alive, out, rows = np.isfinite(d), np.full((len(of), DEGREE), _NONE), np.arange(len(of))
        for k in range(DEGREE):
            first = np.argmax(alive, axis=1)
            any_ = alive[rows, first]
            if not any_.any():
                break
            out[any_, k] = proposed[any_, first[any_]]
            alive &= ~(ALPHA * ALPHA * between[rows, first] <= d)
            alive[rows, first] = False
        return out

    def _insert(self, new: np.ndarray) -> None:
        found, _ = self.search(self.points[new], BUILD_BEAM)
        self.edges[new, :DEGREE] = self._prune(new, found)
        source = np.repeat(new, DEGREE).astype(np.int32)
        target = self.edges[new, :DEGREE].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, many = np.unique(target, return_index=True, return_counts=True)
        # back edges in rounds of up to DEGREE a point; a point that overflows is pruned
        for lo in range(0, int(many.max(initial=0)), DEGREE):
            some = np.flatnonzero(many > lo)
            width = np.arange(DEGREE)
            at = first[some][:, None] + lo + width
            incoming = np.where(lo + width < many[some][:, None], source[np.minimum(at, len(source) - 1)], _NONE)
            old = self.edges[who[some]]
            incoming = np.where((incoming[:, :, None] == old[:, None, :]).any(axis=2), _NONE, incoming)
            both = np.concatenate([old, incoming], axis=1)
            fits = (both >= 0).sum(axis=1) <= DEGREE + SLACK
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE + SLACK]
            self.edges[who[some[fits]]] = packed[fits]
            over = some[~fits]
            for a in range(0, len(over), BATCH):
                part = over[a:a + BATCH]
                self.edges[who[part], :DEGREE] = self._prune(who[part].astype(np.int64), both[~fits][a:a + BATCH])
                self.edges[who[part], DEGREE:] = _NONE


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with the coordinate that brings all to the longest length."""
    norm = np.einsum("nd,nd->n", vectors, vectors)
    more = np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0))
    return np.concatenate([vectors, more[:, None]], axis=1).astype(np.float32)


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """The graph over different vectors (scaled, so large components cannot
    overflow)."""
    scale = np.abs(vectors).max(initial=0.0) or 1.0
    points = lifted(vectors / scale)
    middle = points.mean(axis=0)
    entry = int(np.argmin(((points - middle) ** 2).sum(axis=1)))
    graph = Graph(points, np.full((len(points), DEGREE + SLACK), _NONE), np.array([entry], np.int32))
    order = np.random.default_rng(seed).permutation(len(points))
    order = order[order != entry]
    lo, size = 0, 1
    while lo < len(order):
        graph._insert(order[lo:lo + size])
        lo, size = lo + size, min(BATCH, 2 * size)
    graph.entries = graph._reach()
    return graph
