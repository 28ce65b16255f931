"""Forest of random-projection trees in arrays: fit on a sample, search with one shared queue."""

from __future__ import annotations

import numpy as np


class Forest:
    """``trees`` complete binary trees of one depth.  Node k of a tree has the children 2k+1 and
    2k+2; a leaf is numbered tree * 2**depth + position."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.trees, self.depth = trees, depth
        self.normal = np.zeros((trees * inner, sample.shape[1] if sample.size else 1), np.float32)
        self.offset = np.zeros(trees * inner, np.float32)
        for t in range(trees):
            level = [np.arange(len(sample))]
            for k in range(inner):
                rows = level[k]
                way, at = self._plane(sample, rows, rng)
                self.normal[t * inner + k], self.offset[t * inner + k] = way, at
                right = sample[rows] @ way > at if len(rows) else np.empty(0, bool)
                level += [rows[~right], rows[right]]
                level[k] = None

    @staticmethod
    def _plane(sample: np.ndarray, rows: np.ndarray, rng) -> tuple[np.ndarray, np.float32]:
        """Normal through two random rows of the node, offset at the median of its rows."""
        way = np.zeros(sample.shape[1] if sample.size else 1, np.float32)
        for _ in range(8):
            if len(rows) < 2:
                break
            a, b = rng.choice(rows, 2, replace=False)
            d = sample[a].astype(np.float64) - sample[b]
            size = np.linalg.norm(d)
            if size > 0:
                way = (d / size).astype(np.float32)
                break
        else:
            way = rng.standard_normal(len(way)).astype(np.float32)
            way /= np.linalg.norm(way)
        return way, np.float32(np.median(sample[rows] @ way)) if len(rows) else np.float32(0)

    def probe(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """For each row of ``x`` the ``leaves`` (at least ``trees``) best leaves of all trees.

        A node's priority is that of its parent on the row's side of the plane, else at most minus
        the distance to the plane.  The queue of all trees together is kept level by level: as each
        node passes its priority on to a child, no more than ``leaves`` nodes of a level can
        precede one of the best leaves.  The first ``trees`` leaves are the row's own.
        """
        n, inner = len(x), (1 << self.depth) - 1
        node = np.tile(np.arange(self.trees) * inner, (n, 1))
        base = node.copy()
        rank = np.zeros((n, self.trees), np.float32)
        for _ in range(self.depth):
            margin = np.einsum("nd,npd->np", x, self.normal[node], optimize=False) - self.offset[node]
            left, right = base + 2 * (node - base) + 1, base + 2 * (node - base) + 2
            near, far = np.where(margin > 0, right, left), np.where(margin > 0, left, right)
            node = np.concatenate([near, far], axis=1)
            base = np.concatenate([base, base], axis=1)
            rank = np.concatenate([rank, np.minimum(rank, -np.abs(margin))], axis=1)
            if node.shape[1] > leaves:
                best = np.argpartition(-rank, leaves - 1, axis=1)[:, :leaves]
                # own leaves have priority 0 and stay in front
                own = np.arange(self.trees)[None, :].repeat(n, 0)
                rest = np.where(rank >= 0, -np.inf, rank)
                rest[:, : self.trees] = -np.inf
                more = np.argpartition(-rest, leaves - self.trees - 1, axis=1)[:, : leaves - self.trees] if leaves > self.trees else best[:, :0]
                best = np.concatenate([own, more], axis=1)
                node, base, rank = (np.take_along_axis(v, best, 1) for v in (node, base, rank))
        if not self.depth:
            return node + np.arange(self.trees)
        return base // inner * (1 << self.depth) + (node - base - inner)


def nearest_in_block(queries: np.ndarray, points: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, k: int, block: int = 1024):
    """For each query the k nearest points other than itself: (ids, distances), ranked exactly by
    (distance in double precision, id); -1 and inf where there are fewer."""
    n, m = len(queries), len(points)
    ids, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not m:
        return ids, dist
    middle = points.mean(axis=0, dtype=np.float64).astype(np.float32)
    p = points - middle
    p2 = np.einsum("ij,ij->i", p, p)
    take = min(m, k + 7)
    for a in range(0, n, block):
        q = queries[a : a + block] - middle
        near = p2[None, :] - 2 * (q @ p.T)
        at = np.argpartition(near, take - 1, axis=1)[:, :take] if take < m else np.tile(np.arange(m), (len(q), 1))
        values = np.take_along_axis(near, at, 1)
        diff = queries[a : a + block].astype(np.float64)[:, None, :] - points[at].astype(np.float64)
        exact = np.einsum("qpd,qpd->qp", diff, diff)
        exact[p_ids[at] == q_ids[a : a + block, None]] = np.inf
        order = np.lexsort((p_ids[at], exact), axis=1)[:, :k]
        d, i = np.take_along_axis(exact, order, 1), np.take_along_axis(p_ids[at], order, 1)
        i = np.where(np.isinf(d), -1, i)
        if take < m:  # near-ties at the rim of what was taken: rank all that could matter
            rim, kth = values.max(axis=1), np.partition(values, min(k, take - 1), axis=1)[:, min(k, take - 1)]
            slack = 1e-5 * (np.abs(p2).max() + np.einsum("ij,ij->i", q, q))
            for r in np.flatnonzero(rim <= kth + slack):
                every = np.flatnonzero((near[r] <= kth[r] + slack[r]) & (p_ids != q_ids[a + r]))
                e = ((queries[a + r].astype(np.float64) - points[every].astype(np.float64)) ** 2).sum(axis=1)
                o = np.lexsort((p_ids[every], e))[:k]
                i[r, : len(o)], d[r, : len(o)] = p_ids[every][o], e[o]
        ids[a : a + block, : d.shape[1]], dist[a : a + block, : d.shape[1]] = i, np.sqrt(d)
    return ids, dist
