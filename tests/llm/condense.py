"""Condensed hierarchy over the levels of a spanning forest, for one bounded task (numpy only).

Levels are integers; a larger level means a denser one.  Components at level ``l`` are those
joined by forest edges of level ``>= l``.  Walking from the finest level to the coarsest:

* a component with no child of at least ``min_size`` members starts a chain,
* with one such child it prolongs the chain of that child,
* with several it starts a new chain whose children are theirs.

The stability of a chain is the sum over its levels of the members present, i.e. the excess of
mass on an evenly spaced level axis.  A chain is selected if its stability is at least the best
total of its descendants; the topmost selected chains are the clusters.
"""

from __future__ import annotations

import numpy as np


def _find(parent: np.ndarray, x: int) -> int:
    root = x
    while parent[root] != root:
        root = parent[root]
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def spanning_forest(u: np.ndarray, v: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the edges of a spanning forest of nodes 0..n-1 that prefers edges by ``order``."""
    parent = np.arange(n)
    keep = []
    for k in order:
        x, y = _find(parent, u[k]), _find(parent, v[k])
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.asarray(keep, dtype=np.int64)


def condensed_clusters(a: np.ndarray, b: np.ndarray, level: np.ndarray, n: int, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For nodes 0..n-1: the smallest node of each one's cluster (-1: none), and the finest level
    at which the node is still in a component of its cluster of at least ``min_size`` members."""
    parent, size = np.arange(n), np.ones(n, dtype=np.int64)
    chain_of: dict[int, int] = {}  # root of a component of min_size or more -> its chain
    stability: list[float] = []
    below: list[float] = []
    children: list[list[int]] = []
    top: list[list[int]] = []  # root and level of the chain's coarsest component
    chain_parent: list[int] = []
    leaves_at = np.full(n, -1, dtype=np.int64)  # finest level of a component of min_size
    first_chain = np.full(n, -1, dtype=np.int64)  # the chain in which the node first is
    members: list[list[int]] = [[x] for x in range(n)]

    def best(c: int) -> float:
        return max(stability[c], below[c])

    order = np.argsort(-level, kind="stable")
    levels = level[order]
    at = 0
    present = np.unique(levels)[::-1]
    last = None
    for lev in present:
        if last is not None and last - lev > 1:  # levels without merges: all live on
            for c in chain_of.values():
                stability[c] += (last - lev - 1) * size[_find(parent, top[c][0])]
        touched: dict[int, set] = {}
        while at < len(levels) and levels[at] == lev:
            k = order[at]
            at += 1
            x, y = _find(parent, a[k]), _find(parent, b[k])
            if x == y:
                continue
            r, s = min(x, y), max(x, y)
            got = touched.pop(r, None) or ({chain_of.pop(r)} if r in chain_of else set())
            got |= touched.pop(s, None) or ({chain_of.pop(s)} if s in chain_of else set())
            parent[s] = r
            size[r] += size[s]
            if len(members[r]) < len(members[s]):
                members[r], members[s] = members[s], members[r]
            members[r].extend(members[s])
            members[s] = []
            touched[r] = got
        for r, got in touched.items():
            if size[r] < min_size:
                continue
            if len(got) == 1:
                c = next(iter(got))
                top[c] = [r, lev]
            else:
                c = len(stability)
                stability.append(0.0)
                below.append(sum(best(k) for k in got))
                children.append(sorted(got))
                top.append([r, lev])
                chain_parent.append(-1)
                for k in got:
                    chain_parent[k] = c
            chain_of[r] = c
            new = members[r]
            for x in new:
                if leaves_at[x] < 0:
                    leaves_at[x], first_chain[x] = lev, c
            members[r] = []
        for r, c in chain_of.items():
            stability[c] += size[r]
        last = lev
    if last is not None and last > 0:  # down to level 0 nothing changes any more
        for r, c in chain_of.items():
            stability[c] += last * size[r]
    m = len(stability)
    owner = np.full(m, -1, dtype=np.int64)
    for c in range(m - 1, -1, -1):  # a parent has a larger number than its children
        p = chain_parent[c]
        if p >= 0 and owner[p] >= 0:
            owner[c] = owner[p]
        elif stability[c] >= below[c]:
            owner[c] = c
    own = np.where(first_chain >= 0, owner[first_chain] if m else -1, -1)
    label = np.full(n, -1, dtype=np.int64)
    inside = np.flatnonzero(own >= 0)
    low = np.full(m, n, dtype=np.int64)
    np.minimum.at(low, own[inside], inside)
    label[inside] = low[own[inside]]
    return label, leaves_at
