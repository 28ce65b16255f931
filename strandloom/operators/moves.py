"""Local moves to communities over blocks of a graph that is too large for one task.

Nodes live in the block of their hash with their links; the labels of their neighbours are held
beside them and sent only when they change.  In a round each block asks the blocks of the
communities for their masses and about half of the nodes, by hash, move to the best neighbouring
one at once, so few neighbours change places.  The communities found are then contracted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, LocalBlock, Out, by_home, gathered, home, lookup, mixed

#: Links, both directions counted, that a block is meant to hold.
BLOCK_LINKS = 800_000
#: Rounds of moves before a contraction; they end earlier when fewer than a hundredth of the nodes move.
ROUNDS = 10
#: Entries of the states that moves leave as they are.
_STILL = frozenset({"ids", "size", "within", "strength", "start", "nbr", "w", "far"})
_KINDS = (("u", np.int64), ("v", np.int64), ("w", np.float64), ("n", np.int64))


def _routed(count: int):
    """Edges ``i, j, weight, size`` as bytes for the blocks of both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, w, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            two = i != j
            u, v, w, n = np.concatenate([i, j[two]]), np.concatenate([j, i[two]]), np.concatenate([w, w[two]]), np.concatenate([n, n[two]])
            packed = [(b, b"".join(m[k].astype(t).tobytes() for k, t in _KINDS)) for b, m in by_home(home(u, count), u=u, v=v, w=w, n=n)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names=["block", "data"])

    return run


def _state(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, cpm: bool, kind: type) -> dict:
    """Nodes ``u`` with their links; a row with u = v holds what is within a node."""
    ids = np.unique(u)
    loop = u == v
    own = np.searchsorted(ids, u[loop])
    within = np.bincount(own, weights=w[loop], minlength=len(ids))
    size = np.bincount(own, weights=n[loop], minlength=len(ids)) if loop.any() else np.ones(len(ids))
    u, v, w = u[~loop], v[~loop], w[~loop]
    order = np.lexsort((w, v, u))
    u, v, w = u[order], v[order], w[order]
    last = np.r_[(u[1:] != u[:-1]) | (v[1:] != v[:-1]), [True]] if len(u) else np.zeros(0, bool)  # of repeated edges the heaviest
    u, v, w = u[last], v[last], w[last]
    far, nbr = np.unique(v, return_inverse=True)
    at = np.searchsorted(ids, u)
    strength = size if cpm else np.bincount(at, weights=w, minlength=len(ids)) + 2 * within
    ids, far, start = ids.astype(kind), far.astype(kind), np.searchsorted(at, np.arange(len(ids) + 1))
    return {"ids": ids, "size": size, "within": within, "strength": strength, "start": start, "nbr": nbr.astype(np.int32), "w": w, "far": far, "fcom": far.copy(), "com": ids.copy()}


def _built(cpm: bool, kind: type):
    def build(block: int, count: int, packets: list) -> dict:
        cut = [np.frombuffer(bytes(x), np.int64).reshape(4, -1) for x in packets] or [np.empty((4, 0), np.int64)]
        u, v, w, n = np.concatenate(cut, axis=1)
        return _state(u, v, w.view(np.float64), n, cpm, kind)

    return build


def _at(s: dict) -> np.ndarray:
    """The node of each link."""
    return np.repeat(np.arange(len(s["ids"])), np.diff(s["start"]))


def _heard(s: dict, inbox: list, kind: str) -> None:
    news = gathered(inbox, kind)
    if news is not None:
        at, there = lookup(s["far"], news["id"])
        s["f" + kind][at[there]] = news["to"][there]


def _told(s: dict, count: int, changed: np.ndarray, kind: str) -> Out:
    """The labels of changed nodes for the blocks of their neighbours."""
    at = _at(s)
    some = changed[at]
    pairs = np.unique(at[some] * count + home(s["far"], count)[s["nbr"][some]])
    who = pairs // count
    return [(b, {kind: m}) for b, m in by_home(pairs % count, id=s["ids"][who], to=s[kind][who])]


def _ask(block: int, count: int, s: dict, inbox: list) -> tuple:
    _heard(s, inbox, "com")
    c = np.unique(np.concatenate([s["com"], s["fcom"]]))
    mass = np.bincount(np.searchsorted(c, s["com"]), weights=s["strength"], minlength=len(c))
    return s, [(b, {"part": m}) for b, m in by_home(home(c, count), c=c, m=mass)], float(s["strength"].sum())


def _add(block: int, count: int, s: dict, inbox: list) -> tuple:
    part = gathered(inbox, "part")
    if part is None:
        return s, [], 0
    c, back = np.unique(part["c"], return_inverse=True)
    mass = np.bincount(back, weights=part["m"])[back]
    return s, [(b, {"mass": m}) for b, m in by_home(part["src"], c=part["c"], m=mass)], 0


def _move(block: int, count: int, s: dict, inbox: list, total: float, resolution: float, turn: int) -> tuple:
    mass, n = gathered(inbox, "mass"), len(s["ids"])
    if mass is None:
        return s, [], (0, n)
    order = np.argsort(mass["c"])
    known, mass = mass["c"][order], mass["m"][order]
    active = (mixed(s["ids"].astype(np.int64) + turn * 1_000_003) & np.uint64(1)).astype(bool)
    mine = np.searchsorted(known, s["com"])
    at = _at(s)
    some = active[at]
    key = at[some] * len(known) + np.searchsorted(known, s["fcom"])[s["nbr"][some]]
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    if not len(key):
        return s, [], (0, n)
    links, u, c = np.add.reduceat(s["w"][some][order], first), key // len(known), key % len(known)
    share = resolution * s["strength"] / total
    held = mine[u] == c
    gain = links - share[u] * (mass[c] - np.where(held, s["strength"][u], 0))
    stay = -share * (mass[mine] - s["strength"])
    stay[u[held]] = gain[held]
    who, start = np.unique(u, return_index=True)
    top = np.maximum.reduceat(gain, start)
    best = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(u)])))
    best = best[np.unique(u[best], return_index=True)[1]]  # the smallest of equal ones
    go = top > stay[who] + 1e-12
    changed = np.zeros(n, bool)
    changed[who[go]] = True
    com = s["com"].copy()
    com[who[go]] = known[c[best[go]]]
    s = s | {"com": com}
    return s, _told(s, count, changed, "com"), (int(go.sum()), n)


def _spread(block: int, count: int, s: dict, inbox: list) -> tuple:
    """The smallest id of each connected part of a community, one link further a step."""
    _heard(s, inbox, "com")
    if "root" not in s:
        s = s | {"root": s["ids"].copy(), "froot": s["far"].copy()}
    _heard(s, inbox, "root")
    at, root = _at(s), s["root"].copy()
    same = s["fcom"][s["nbr"]] == s["com"][at]
    np.minimum.at(root, at[same], s["froot"][s["nbr"][same]])
    changed = root < s["root"]
    s = s | {"root": root}
    return s, _told(s, count, changed, "root"), int(changed.sum())


def _settle(block: int, count: int, s: dict, inbox: list) -> tuple:
    _heard(s, inbox, "com")
    if "root" in s:
        s = s | {"com": s["root"], "fcom": s["froot"]}
    return s, [], 0


def _rows(s: dict) -> dict:
    """Labels ``a, b`` (n is -1) and, once per edge, the contracted graph ``a, b, w, n``."""
    at = _at(s)
    u, v = s["com"][at], s["fcom"][s["nbr"]]
    once = s["ids"][at] < s["far"][s["nbr"]]
    a, b = np.concatenate([np.minimum(u, v)[once], s["com"]]), np.concatenate([np.maximum(u, v)[once], s["com"]])
    w, n = np.concatenate([s["w"][once], s["within"]]), np.concatenate([np.zeros(once.sum()), s["size"]])
    order = np.lexsort((b, a))
    a, b, w, n = a[order], b[order], w[order], n[order]
    first = np.flatnonzero(np.r_[[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    total = lambda x: np.add.reduceat(x, first) if len(first) else x
    return {"a": np.r_[s["ids"], a[first]].astype(np.int64), "b": np.r_[s["com"], b[first]].astype(np.int64), "w": np.r_[np.zeros(len(s["ids"])), total(w)], "n": np.r_[np.full(len(s["ids"]), -1), total(n).astype(np.int64)]}


def _rounds(blocks: Blocks | LocalBlock, resolution: float, cpm: bool, connected: bool, seed: int) -> int:
    """Rounds of moves; the number of nodes."""
    for turn in range(ROUNDS):
        total = sum(blocks.step(_ask))
        blocks.step(_add, held=False)
        moved, nodes = map(sum, zip(*blocks.step(_move, 1.0 if cpm else max(total, 1e-300), resolution, seed + turn)))
        if moved <= nodes / 100 and turn > 1:
            break
    while connected and sum(blocks.step(_spread)):
        pass
    blocks.step(_settle)
    return nodes


def contracted_here(i: np.ndarray, j: np.ndarray, w: np.ndarray, size: np.ndarray, resolution: float, cpm: bool, connected: bool, seed: int) -> tuple[tuple, tuple]:
    """One level of moves over edges (i = j as in ``contracted``) that one task holds: sorted ids and
    their labels, and the columns of the graph of the communities."""
    two = i != j
    block = LocalBlock(_state(np.concatenate([i, j[two]]), np.concatenate([j, i[two]]), np.concatenate([w, w[two]]), np.concatenate([size, size[two]]), cpm, np.int64), [])
    _rounds(block, resolution, cpm, connected, seed)
    rows = _rows(block.state)
    label = rows["n"] < 0
    return (rows["a"][label], rows["b"][label]), tuple(rows[k][~label] for k in "abwn")


def contracted(edges: DataFrame, rows: int, largest: int, resolution: float, cpm: bool, connected: bool, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """One level of moves over ``i, j, weight, size`` (a row with i = j holds what is within a node):
    labels ``id, community``, the graph of the communities, and whether it has fewer nodes."""
    count = 1 << max(0, int(np.ceil(np.log2(max(1, 2 * rows / BLOCK_LINKS)))))
    blocks = Blocks.load(edges.select("i", "j", "weight", "size").mapInArrow(_routed(count), "block int, data binary"), count, _built(cpm, np.int32 if largest < 2**31 else np.int64))
    blocks.rdd._jrdd.count()
    blocks.rdd._jrdd.rdd().cleanShuffleDependencies(False)  # the files of the edges
    blocks.hold(_STILL)
    nodes = _rounds(blocks, resolution, cpm, connected, seed)
    found = blocks.frame(_rows, "a bigint, b bigint, w double, n bigint")
    labels = found.where("n < 0").select(F.col("a").alias("id"), F.col("b").alias("community"))
    graph = found.where("n >= 0").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("weight"), F.sum("n").alias("size"))
    return labels, graph, found.where("n > 0").select("a").distinct().count() < nodes
