"""How alike the two ends of an edge are, by walks over the graph from both.

Each node starts with a pseudo-random signature.  A walk of k steps from a node averages the
signatures of where it ends, so two nodes whose walks end at the same nodes get the same one.  Plain
averages mix slowly; the Chebyshev polynomial of a walk,
x(k+1) = 2/BAND * walk(x(k)) - x(k-1), keeps what decays faster than BAND a step and lets the rest
grow, so what remains is common to a whole cluster after about half as many steps.  (All is divided
by the growth of a mode of LEAD, so the numbers stay in range.)

The links of a node are in its home block; those of a node with very many are spread over all
blocks, whose partial sums its home adds up.  Between blocks go signatures of 4 bits a number, each
once per block that needs it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .blocks import Out, by_home, gathered, home, lookup, mixed

DIMS = 32
#: Signatures travel as whole numbers of -GRAIN..GRAIN, two of them in a byte.
GRAIN = 7
#: Modes that shrink to less than BAND in a step of a walk don't grow; those of clusters, which
#: keep LEAD and more, must outgrow them by 2 * sqrt(nodes): a cluster of m nodes has only
#: 1/sqrt(m) of its signatures' length in common at first.
BAND, LEAD = 0.6, 0.9
GROWTH = LEAD / BAND + math.sqrt((LEAD / BAND) ** 2 - 1)
#: Steps go on while the mean agreement gains at least this part of what it lacks.
GAIN = 0.05
#: Steps less one at the end that average directions only: the common part of a large cluster is
#: shorter than that of a small one, which would outweigh it at the ends of stray edges.
PLAIN = 4
#: Links of a node up to this number are summed in columns of equal rank.
COLUMNS = 64


def least_steps(nodes: int) -> int:
    return max(3, math.ceil(math.acosh(2 * math.sqrt(max(nodes, 1))) / math.acosh(LEAD / BAND)))


def start(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random vector of -1 and 1 for each id."""
    bits = np.unpackbits(mixed(mixed(ids)).view(np.uint8).reshape(-1, 8), axis=1)[:, :DIMS]
    return bits.astype(np.float32) * 2 - 1


def pack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values in a byte, and the scale of each row."""
    top = np.abs(x).max(axis=1) if len(x) else np.empty(0, np.float32)
    scale = np.where(top > 0, top, 1).astype(np.float32)
    q = (np.rint(x / scale[:, None] * GRAIN) + GRAIN).astype(np.uint8)
    return (q[:, 0::2] << 4) | q[:, 1::2], scale / GRAIN


def unpack(packed: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    out = np.empty((len(packed), DIMS), np.float32)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    out -= GRAIN
    return out if scale is None else out * scale[:, None]


def spread(count: int, heavy: np.ndarray):
    """Batches ``i, j, weight`` of usable edges to rows ``block, data``: links in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j, w = (batch.column(k).to_numpy() for k in range(3))
            to, src, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
            at = home(to, count)
            large = lookup(heavy, to)[1]
            at[large] = home(to[large] ^ mixed(src[large]).astype(np.int64), count)
            blocks, data = [], []
            for b, part in by_home(at, to=to, src=src, w=w):
                blocks.append(b)
                data.append(np.array([len(part["to"])], np.int64).tobytes() + part["to"].tobytes() + part["src"].tobytes() + part["w"].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    return run


def build(heavy: np.ndarray):
    def run(block: int, count: int, data: list) -> dict:
        parts = [np.frombuffer(x, np.int64) for x in data]
        to, src, w = (np.concatenate([np.empty(0, np.int64), *(x[1 + k * x[0] : 1 + (k + 1) * x[0]] for x in parts)]) for k in range(3))
        w = w.view(np.float64)
        order = np.lexsort((-w, src, to))
        to, src, w = to[order], src[order], w[order]
        once = np.ones(len(to), bool)
        once[1:] = (to[1:] != to[:-1]) | (src[1:] != src[:-1])
        to, src, w = to[once], src[once], w[once].astype(np.float32)
        nodes = np.union1d(to, heavy[home(heavy, count) == block])
        need = np.union1d(src, nodes[home(nodes, count) != block])
        need = need[np.argsort(home(need, count), kind="stable")]
        sorter = np.argsort(need)
        away = np.flatnonzero(home(nodes, count) != block)
        place = lambda ids: sorter[np.searchsorted(need, ids, sorter=sorter)].astype(np.int32)
        return {"nodes": nodes, "first": np.concatenate([np.searchsorted(to, nodes), [len(to)]]), "w": w, "need": need, "src": place(src), "away": away, "their": place(nodes[away]), "send": []}

    return run


def _own(st: dict) -> np.ndarray:
    own = np.ones(len(st["nodes"]), bool)
    own[st["away"]] = False
    return own


def _to(st: dict) -> np.ndarray:
    return np.repeat(np.arange(len(st["nodes"])), np.diff(st["first"]))


def subscribe(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """Ask the homes for the nodes that the block's links come from."""
    out = [(b, {"need": m}) for b, m in by_home(home(st["need"], count), ids=st["need"])]
    return st, out, (int(_own(st).sum()),)


def _sums(st: dict, x: np.ndarray) -> np.ndarray:
    """Weighted sums over the links of each node of the rows of ``x``, of their lengths, and of 1."""
    n, first = len(st["nodes"]), st["first"]
    cnt = np.diff(first)
    rank = np.argsort(-cnt, kind="stable")
    falling = -cnt[rank]
    x = np.column_stack([x, np.linalg.norm(x, axis=1), np.ones(len(x), np.float32)])
    acc = np.zeros((n, x.shape[1]), np.float32)
    for k in range(min(COLUMNS, -int(falling[0])) if n else 0):  # the k-th link of every node that has one
        links = first[rank[: np.searchsorted(falling, -k)]] + k
        acc[: len(links)] += x[st["src"][links]] * st["w"][links, None]
    for r in range(np.searchsorted(falling, -COLUMNS)):
        for a in range(first[rank[r]] + COLUMNS, first[rank[r] + 1], 50_000):
            links = slice(a, min(a + 50_000, first[rank[r] + 1]))
            acc[r] += st["w"][links] @ x[st["src"][links]]
    out = np.empty_like(acc)
    out[rank] = acc
    return out


def _received(st: dict, inbox: list) -> np.ndarray:
    m = gathered(inbox, "x")
    return unpack(m["packed"], m["scale"]) if m else np.empty((0, DIMS), np.float32)


def walk(block: int, count: int, st: dict, inbox: list, first: bool, plain: bool, own_part: bool) -> tuple[dict, Out, tuple]:
    """Sum up what has come.  With ``own_part`` shared sums follow, else the step ends here."""
    if first:
        asked = [(src, m["need"]["ids"]) for src, m in inbox if "need" in m]
        st["send"] = [(src, np.searchsorted(st["nodes"], ids).astype(np.int32)) for src, ids in asked]
        x = start(st.pop("need"))
        st["x"], st["before"] = start(st["nodes"]).astype(np.float16), None
    else:
        x = _received(st, inbox)
    if plain:
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    st["sums"] = _sums(st, x)
    if not own_part:
        return _advance(st, plain)
    away = st["away"]
    out = [(b, {"part": m}) for b, m in by_home(home(st["nodes"][away], count), ids=st["nodes"][away], s=st["sums"][away])]
    return st, out, ()


def add_parts(block: int, count: int, st: dict, inbox: list, plain: bool) -> tuple[dict, Out, tuple]:
    parts = gathered(inbox, "part")
    if parts:
        np.add.at(st["sums"], np.searchsorted(st["nodes"], parts["ids"]), parts["s"])
    return _advance(st, plain)


def _advance(st: dict, plain: bool) -> tuple[dict, Out, tuple]:
    sums = st.pop("sums")
    lengths, weights = sums[:, DIMS], sums[:, DIMS + 1]
    mean = sums[:, :DIMS] / np.where(weights > 0, weights, 1)[:, None]
    after = mean if plain else mean / (BAND * GROWTH) if st["before"] is None else 2 / (BAND * GROWTH) * mean - st["before"] / np.float32(GROWTH**2)
    st["before"], st["x"] = st["x"], after.astype(np.float16)
    agree = np.linalg.norm(sums[:, :DIMS], axis=1) / np.where(lengths > 0, lengths, 1)
    own = _own(st)
    return st, sent(st), (int(own.sum()), float(agree[own].sum(dtype=np.float64)))


def sent(st: dict) -> Out:
    packed, scale = pack(st["x"].astype(np.float32))
    return [(b, {"x": {"packed": packed[at], "scale": scale[at]}}) for b, at in st["send"]]


def compare(block: int, count: int, st: dict, inbox: list, core: int) -> tuple[dict, Out, tuple]:
    """The cosines of the links, and each node's ``core`` best ones."""
    x = _received(st, inbox)
    mine, to_of, away = unpack(*pack(st["x"].astype(np.float32))), _to(st), st["away"]
    mine[away] = x[st["their"]]
    size, other = np.linalg.norm(mine, axis=1), np.linalg.norm(x, axis=1)
    s = np.empty(len(to_of), np.float32)
    for a in range(0, len(s), 100_000):
        t, f = to_of[a : a + 100_000], st["src"][a : a + 100_000]
        both = size[t] * other[f]
        s[a : a + 100_000] = np.einsum("ij,ij->i", mine[t], x[f]) / np.where(both > 0, both, 1)
    best = np.full((len(st["nodes"]), core), -2, np.float32)
    order = np.lexsort((-s, to_of))
    to = to_of[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    few = rank < core
    best[to[few], rank[few]] = s[order][few]
    for k in ("x", "before", "w"):
        del st[k]
    st["s"], st["best"] = s, best
    out = [(b, {"best": m}) for b, m in by_home(home(st["nodes"][away], count), ids=st["nodes"][away], best=best[away])]
    return st, out, ()


def cores(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """The similarity of each node to its ``core``-th most similar one (of fewer: the last)."""
    parts, best = gathered(inbox, "best"), st.pop("best")
    if parts:
        to = np.concatenate([np.repeat(np.arange(len(best)), best.shape[1]), np.repeat(np.searchsorted(st["nodes"], parts["ids"]), best.shape[1])])
        s = np.concatenate([best.ravel(), parts["best"].ravel()])
        order = np.lexsort((-s, to))
        to = to[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        few = rank < best.shape[1]
        best[to[few], rank[few]] = s[order][few]
    least = np.where(best > -2, best, 2).min(axis=1) if len(best) else np.empty(0, np.float32)
    st["core"] = least.astype(np.float32)
    return st, [(b, {"core": {"c": st["core"][at], "id": st["nodes"][at]}}) for b, at in st.pop("send")], ()


def reachable(block: int, count: int, st: dict, inbox: list, step: float) -> tuple[dict, Out, tuple]:
    """Mutual reachability and level of each edge, kept where its smaller end's links are."""
    m = gathered(inbox, "core")
    other, need = (m["c"], m["id"]) if m else (np.empty(0, np.float32), np.empty(0, np.int64))
    mine, to = st["core"], _to(st)
    mine[st["away"]] = other[st["their"]]
    a, b = st["nodes"][to], need[st["src"]]
    s = np.minimum(np.minimum(st["s"], mine[to]), other[st["src"]])
    level = np.maximum(0, np.floor(-np.log(np.maximum(1e-3, 1 - s)) / step)).astype(np.int16)
    keep = a < b
    own = st["nodes"][_own(st)]
    return {"nodes": own, "a": a[keep], "b": b[keep], "s": s[keep], "level": level[keep]}, [], (int(keep.sum()), len(own))


def similarities(blocks, core: int, step: float, any_heavy: bool, steps: int | None = None) -> tuple[int, int]:
    """The program up to ``reachable``; the number of edges and of nodes."""
    n = sum(s[0] for s in blocks.step(subscribe))
    least, done, agreed = steps or least_steps(n), 0, 0.0
    settling = PLAIN
    while n and settling:
        plain = settling < PLAIN
        stats = blocks.step(walk, done == 0, plain, any_heavy)
        if any_heavy:
            stats = blocks.step(add_parts, plain)
        done += 1
        before, agreed = agreed, sum(s[1] for s in stats) / n
        if plain or done >= least and (steps or 1 - agreed < 1e-3 or agreed - before < GAIN * (1 - agreed)):
            settling -= 1
    if not n:
        return 0, 0
    blocks.step(compare, core)
    blocks.step(cores)
    stats = blocks.step(reachable, step)
    return sum(s[0] for s in stats), sum(s[1] for s in stats)
