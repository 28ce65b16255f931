"""Borůvka rounds over blocks of edges, level by level, and the condensed hierarchy they give.

Edges are ordered by (similarity downwards, a, b); levels are whole numbers, finer ones larger.
In a round each component takes its best edge of the finest level that is left (no other edge of
it is better), and components joined by these edges are contracted; the edges taken make up the
maximum spanning forest.  When a level has no edge left between two components, its components are
those of the hierarchy at this level:

* a component of at least ``min_size`` nodes that holds no chain yet starts one,
* one that holds one chain prolongs it,
* one that holds several starts a new chain, their parent.

The stability of a chain is the sum of its members over its levels.  A chain is selected if its
stability is at least the best total of its descendants; the topmost selected ones are the
clusters.  A node's persistence is the finest level at which its component has ``min_size`` nodes.

Blocks first take the forest of their own edges.  Edges never move.  A component lives in the home block of its id and knows which blocks watch it:
those with edges, nodes or ended chains of it.  Blocks send the best edge of a component once and
ask for a component once, so a component with most of the graph gets no more than a row per block
and message.  A round sends rows of components with edges of the level only.
"""

from __future__ import annotations

import numpy as np

from .blocks import Blocks, LocalBlock, Out, by_home, gathered, home, lookup

_COMP = {"id": np.int64, "size": np.int64, "k": np.int64, "cr": np.int64, "cl": np.int16, "stab": np.float64, "below": np.float64, "best": np.float64}
_CHAIN = {"cr": np.int64, "cl": np.int16, "pr": np.int64, "pl": np.int16, "stab": np.float64, "below": np.float64}
_TABLES = {
    # by level, similarity (both downwards), a, b; u and v are places in "seen"
    "edges": {"u": np.int32, "v": np.int32, "a": np.int64, "b": np.int64, "s": np.float32, "level": np.int16},
    # sums over what a component has taken in at this level; "was" is what it had before
    "comps": _COMP,
    "was": {"k": np.int64, "cr": np.int64, "cl": np.int16, "stab": np.float64, "below": np.float64},
    "nodes": {"id": np.int64, "cur": np.int32},
    "ended": {"cur": np.int32, "cr": np.int64, "cl": np.int16, "stab": np.float64, "below": np.float64},
    "watchers": {"c": np.int64, "src": np.int32},
    "placed": {"id": np.int64, "level": np.int16, "cr": np.int64, "cl": np.int16},
    "chains": _CHAIN,
    "forest": {"a": np.int64, "b": np.int64, "s": np.float32},
}


def _empty(kind: str) -> dict[str, np.ndarray]:
    return {k: np.empty(0, t) for k, t in _TABLES[kind].items()}


def _cat(*tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}


def _rows(t: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in t.items()}


def _ordered(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _rows(e, np.lexsort((e["b"], e["a"], -e["s"], -e["level"])))


def _forest(e: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """The rows of ordered edges that are in the spanning forest of these edges: one that closes a
    cycle of better ones is in no forest of more edges either."""
    u, v, row = e["u"], e["v"], np.arange(len(e["u"]))
    kept, last = [], len(row)
    while len(row):
        best = np.full(n, last)
        best[v[::-1]] = row[::-1]  # the first row of a component is written last
        of_u = np.full(n, last)
        of_u[u[::-1]] = row[::-1]
        best = np.minimum(best, of_u)
        c = np.flatnonzero(best < last)
        kept.append(np.unique(best[c]))
        at = np.searchsorted(row, best[c])
        up = np.arange(n)
        up[c] = np.where(u[at] == c, v[at], u[at])
        up = np.where((up[up] == np.arange(n)) & (np.arange(n) < up), np.arange(n), up)
        while (up[up] != up).any():
            up = up[up]
        u, v = up[u], up[v]
        left = u != v
        u, v, row = u[left], v[left], row[left]
    return _rows(e, np.sort(np.concatenate(kept))) if kept else e


def begin(block: int, count: int, st: dict, inbox: list, keep_forest: bool) -> tuple[dict, Out, tuple]:
    """Every node is a component; the blocks that see it tell its home."""
    n = st["nodes"]
    seen, at = np.unique(np.concatenate([st["a"], st["b"], n]), return_inverse=True)
    u, v, cur = np.split(at.astype(np.int32), [len(st["a"]), 2 * len(st["a"])])
    comps = {k: np.zeros(len(n), t) for k, t in _COMP.items()} | {"id": n, "size": np.ones(len(n), np.int64)}
    new = {"edges": _forest(_ordered({"u": u, "v": v} | {k: st[k] for k in ("a", "b", "s", "level")}), len(seen)), "seen": seen, "comps": comps}
    new |= {"was": {k: comps[k].copy() for k in _TABLES["was"]}, "nodes": {"id": n, "cur": cur}} | {k: _empty(k) for k in ("ended", "watchers", "placed", "chains", "forest")}
    out = [(to, {"watch": m}) for to, m in by_home(home(seen, count), c=seen)]
    return new | {"touched": np.zeros(len(n), bool), "keep_forest": keep_forest}, out, (int(st["level"].max(initial=-1)),)


def joined(states: list[dict]) -> dict:
    """One block of several, between two steps of ``pick`` and ``elect``."""
    seen, at = np.unique(np.concatenate([s["seen"] for s in states]), return_inverse=True)
    for s, place in zip(states, np.split(at.astype(np.int32), np.cumsum([len(s["seen"]) for s in states])[:-1])):
        _moved(s, place)
    out = {k: _cat(*(s[k] for s in states)) for k in _TABLES}
    order = np.argsort(out["comps"]["id"], kind="stable")
    out["comps"], out["was"] = _rows(out["comps"], order), _rows(out["was"], order)
    out["edges"], out["watchers"] = _forest(_ordered(out["edges"]), len(seen)), _unique_watchers(out["watchers"])
    return out | {"seen": seen, "touched": np.concatenate([s["touched"] for s in states])[order], "keep_forest": states[0]["keep_forest"]}


def _unique_watchers(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((w["src"], w["c"]))
    w = _rows(w, order)
    first = np.ones(len(order), bool)
    first[1:] = (w["c"][1:] != w["c"][:-1]) | (w["src"][1:] != w["src"][:-1])
    return _rows(w, first)


def _moved(st: dict, place: np.ndarray) -> None:
    for table, columns in (("edges", "uv"), ("nodes", ["cur"]), ("ended", ["cur"])):
        for k in columns:
            st[table][k] = place[st[table][k]]


def _follow(st: dict, c: np.ndarray, r: np.ndarray) -> None:
    """Components that were contracted, and (r = c) new ones to be watched."""
    order = np.argsort(c)
    at, hit = lookup(c[order], st["seen"])
    now = np.where(hit, r[order][at], st["seen"]) if len(c) else st["seen"]
    st["seen"], place = np.unique(np.concatenate([now, r]), return_inverse=True)
    _moved(st, place[: len(now)].astype(np.int32))
    st["edges"] = _rows(st["edges"], st["edges"]["u"] != st["edges"]["v"])


def _absorb(st: dict, dead: dict[str, np.ndarray]) -> None:
    at = np.searchsorted(st["comps"]["id"], dead["r"])
    st["touched"][at] = True
    for k in _COMP:
        if k != "id":
            np.add.at(st["comps"][k], at, dead[k])


def _told(st: dict, said: dict[str, np.ndarray]) -> None:
    """What large components hold at the end of a level: their nodes are placed, ended chains get
    their parent unless the same chain goes on."""
    order = np.argsort(said["id"])
    said = _rows(said, order)
    at, hit = lookup(said["id"], st["seen"][st["nodes"]["cur"]])
    new = {"id": st["nodes"]["id"][hit], "level": said["level"][at[hit]], "cr": said["cr"][at[hit]], "cl": said["cl"][at[hit]]}
    st["placed"] = _cat(st["placed"], new)
    st["nodes"] = _rows(st["nodes"], ~hit)
    x = st["ended"]
    at, hit = lookup(said["id"], st["seen"][x["cur"]])
    pr, pl = (said[k][at] if len(at) and len(said["id"]) else np.zeros(len(x["cur"]), _CHAIN["p" + k[1]]) for k in ("cr", "cl"))
    over = hit & ((pr != x["cr"]) | (pl != x["cl"]))
    st["chains"] = _cat(st["chains"], {"cr": x["cr"][over], "cl": x["cl"][over], "pr": pr[over], "pl": pl[over], "stab": x["stab"][over], "below": x["below"][over]})
    st["ended"] = _rows(x, ~hit)


def pick(block: int, count: int, st: dict, inbox: list, level: int) -> tuple[dict, Out, tuple]:
    """Follow what was contracted, and send the best edge of each component seen here."""
    moves, dead, said, watch = (gathered(inbox, k) for k in ("moves", "dead", "said", "watch"))
    if moves:
        _follow(st, moves["c"], moves["r"])
    if dead:
        _absorb(st, dead)
    if watch:
        st["watchers"] = _unique_watchers(_cat(st["watchers"], {"c": watch["c"], "src": watch["src"] if "of" not in watch else watch["of"]}))
    if said:
        _told(st, said)
    e = st["edges"]
    n = int(np.searchsorted(-e["level"], -level, side="right"))
    u, v = e["u"][:n].astype(np.int64), e["v"][:n].astype(np.int64)
    first = np.unique(np.minimum(u, v) * len(st["seen"]) + np.maximum(u, v), return_index=True)[1]
    if len(first) < n:  # of edges between the same two components the best one
        first.sort()
        e = st["edges"] = _rows(e, np.concatenate([first, np.arange(n, len(e["u"]))]))
        n = len(first)
    ends = np.column_stack([e["u"][:n], e["v"][:n]]).ravel()
    c, at = np.unique(ends, return_index=True)
    row, c, p = at // 2, st["seen"][c], st["seen"][ends[at ^ 1]]
    out = [(to, {"best": m}) for to, m in by_home(home(c, count), c=c, p=p, s=e["s"][row], a=e["a"][row], b=e["b"][row])]
    after = int(e["level"][n]) if n < len(e["level"]) else -1
    return st, out, (n, after, max(len(e["u"]), len(st["nodes"]["id"]) + len(st["comps"]["id"]), len(st["placed"]["id"])))


def elect(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """The best edge of each component, and a question to the component at its other end."""
    best = gathered(inbox, "best")
    if best:
        order = np.lexsort((best["b"], best["a"], -best["s"], best["c"]))
        first = np.ones(len(order), bool)
        first[1:] = best["c"][order][1:] != best["c"][order][:-1]
        st["picks"] = _rows({k: best[k] for k in "cpsab"}, order[first])
    else:
        st["picks"] = {k: np.empty(0, np.float32 if k == "s" else np.int64) for k in "cpsab"}
    p = np.unique(st["picks"]["p"])
    return st, [(to, {"ask": m}) for to, m in by_home(home(p, count), p=p)], ()


def _answers(st: dict, kind: str, value: np.ndarray) -> Out:
    """``value`` of each component (-1: unknown) to the blocks that asked for it."""
    p, src = st["askers"]
    at = np.searchsorted(st["picks"]["c"], p)
    some = st["known"][at] if kind == "root" else np.ones(len(p), bool)
    return [(to, {kind: m}) for to, m in by_home(src[some], p=p[some], x=value[at[some]])]


def answer(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    ask = gathered(inbox, "ask")
    st["askers"] = (ask["p"], ask["src"]) if ask else (np.empty(0, np.int64), np.empty(0, np.int32))
    return st, _answers(st, "pick", st["picks"]["p"]), ()


def root(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """Of two components that picked each other, the smaller one is a root."""
    m, picks = gathered(inbox, "pick"), st["picks"]
    c, p = picks["c"], picks["p"]
    back = np.zeros(len(c), np.int64)
    if m:
        order = np.argsort(m["p"])
        at, _ = lookup(m["p"][order], p)
        back = m["x"][order][at] if len(at) else back
    st["known"] = back == c if len(c) else np.zeros(0, bool)
    st["root"] = np.where(st["known"], np.minimum(c, p), c)
    return st, _answers(st, "root", st["root"]), ()


def merge(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """A component whose pick has found its root joins it, the others wait for the next round."""
    m, picks = gathered(inbox, "root"), st.pop("picks")
    c, known, r = picks["c"], st.pop("known"), st.pop("root")
    if m:
        order = np.argsort(m["p"])
        at, hit = lookup(m["p"][order], picks["p"])
        r = np.where(~known & hit, m["x"][order][at], r)
        known = known | hit
    dies = known & (r != c)
    c, r = c[dies], r[dies]
    if st["keep_forest"]:
        st["forest"] = _cat(st["forest"], {k: picks[k][dies] for k in "abs"})
    at = np.searchsorted(st["comps"]["id"], c)
    gone, had = _rows(st["comps"], at), _rows(st["was"], at)
    some = had["k"] > 0
    if some.any():  # this block now watches for the ended chains
        _follow(st, r[:0], np.unique(r[some]))
        st["ended"] = _cat(st["ended"], {"cur": np.searchsorted(st["seen"], r[some]).astype(np.int32)} | {k: had[k][some] for k in ("cr", "cl", "stab", "below")})
    out = [(to, {"dead": x}) for to, x in by_home(home(r, count), r=r, **{k: gone[k] for k in _COMP if k != "id"})]
    stay = np.ones(len(st["comps"]["id"]), bool)
    stay[at] = False
    st["comps"], st["was"], st["touched"] = _rows(st["comps"], stay), _rows(st["was"], stay), st["touched"][stay]
    w = st["watchers"]
    at, hit = lookup(c, w["c"])
    now, src = r[at[hit]], w["src"][hit]
    out += [(to, {"moves": x}) for to, x in by_home(src, c=w["c"][hit], r=now)]
    now, src = np.concatenate([now, r[some]]), np.concatenate([src, np.full(int(some.sum()), block, np.int32)])
    out += [(to, {"watch": x}) for to, x in by_home(home(now, count), c=now, of=src)]
    st["watchers"] = _rows(w, ~hit)
    del st["askers"]
    return st, out, ()


def close(block: int, count: int, st: dict, inbox: list, level: int, after: int, min_size: int) -> tuple[dict, Out, tuple]:
    """The end of a level; the next one with edges is ``after``."""
    c, was, w = st["comps"], st["was"], st["watchers"]
    del st["picks"]
    fresh = st["touched"] & (c["size"] >= min_size)
    new = fresh & (c["k"] != 1)
    over = new & (was["k"] > 0)
    st["chains"] = _cat(st["chains"], {"cr": was["cr"][over], "cl": was["cl"][over], "pr": c["id"][over], "pl": np.full(int(over.sum()), level, np.int16), "stab": was["stab"][over], "below": was["below"][over]})
    c["below"] = np.where(new, c["best"], c["below"])
    c["stab"] = np.where(new, 0.0, c["stab"])
    c["cr"], c["cl"] = np.where(new, c["id"], c["cr"]), np.where(new, level, c["cl"]).astype(np.int16)
    c["k"] = np.where(new, 1, c["k"])
    c["stab"] = c["stab"] + np.where(c["k"] > 0, c["size"] * (level - after), 0)
    c["best"] = np.where(c["k"] > 0, np.maximum(c["stab"], c["below"]), 0.0)
    st["was"] = {k: c[k].copy() for k in _TABLES["was"]}
    st["touched"] = np.zeros(len(c["id"]), bool)
    at, hit = lookup(c["id"], w["c"])
    hit = hit & (fresh[at] if len(fresh) else False)
    at = at[hit]
    return st, [(to, {"said": m}) for to, m in by_home(w["src"][hit], id=c["id"][at], cr=c["cr"][at], cl=c["cl"][at], level=np.full(len(at), level, np.int16))], ()


def levels(blocks: Blocks | LocalBlock, level: int, min_size: int, block_rows: int) -> None:
    """The program of all levels from ``level`` downwards; goes on within one task as soon as one
    block is left.  Blocks are joined when they hold few rows each."""
    while True:
        stats = blocks.step(pick, level)
        active, after, held = sum(s[0] for s in stats), max(s[1] for s in stats), sum(s[2] for s in stats)
        count = blocks.count
        while count > 1 and held <= block_rows * count:  # such rows are light
            count //= 2
        if count < blocks.count:
            blocks.fewer(count, joined)
            if count == 1:
                blocks.within(_rest, level, active, after, min_size, block_rows)
                return
        if not _round(blocks, level, active, after, min_size):
            return
        level = level if active else after


def _rest(only: LocalBlock, level: int, active: int, after: int, min_size: int, block_rows: int) -> None:
    """What is left of a round whose picks are made, and all later ones."""
    if _round(only, level, active, after, min_size):
        levels(only, level if active else after, min_size, block_rows)


def _round(blocks: Blocks | LocalBlock, level: int, active: int, after: int, min_size: int) -> bool:
    blocks.step(elect)
    if active:
        for fn in (answer, root, merge):
            blocks.step(fn)
    else:
        blocks.step(close, level, after, min_size)
        if after < 0:
            blocks.step(pick, -1)
            return False
    return True


# ---- selection of the chains


def _keyed(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Numbers for pairs, equal in all of them for equal pairs."""
    r, l = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    numbers = np.unique(np.unique(r, return_inverse=True)[1] * 32768 + l.astype(np.int64), return_inverse=True)[1]
    return np.split(numbers, np.cumsum([len(p[0]) for p in pairs])[:-1])


def _matched(keys: tuple, wanted: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted pair its row among ``keys`` (unique pairs), and whether there is one."""
    k, w = _keyed(keys, wanted)
    order = np.argsort(k)
    at, hit = lookup(k[order], w)
    return order[at] if len(order) else at, hit


def house(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """Chains that are left are topmost; every chain goes to the home of its name."""
    c = _rows(st["comps"], st["comps"]["k"] > 0)
    st["chains"] = _cat(st["chains"], {"cr": c["cr"], "cl": c["cl"], "pr": c["cr"], "pl": c["cl"], "stab": c["stab"], "below": c["below"]})
    out = [(to, {"chain": m}) for to, m in by_home(home(st["chains"]["cr"], count), **st["chains"])]
    return {k: st[k] for k in ("placed", "forest")}, out, ()


def choose(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    m = gathered(inbox, "chain")
    t = st["table"] = {k: m[k] for k in _CHAIN} if m else _empty("chains")
    top = (t["pr"] == t["cr"]) & (t["pl"] == t["cl"])
    st["done"], st["has"] = top, t["stab"] >= t["below"]
    st["or"], st["ol"] = t["cr"].copy(), t["cl"].copy()
    ask = np.flatnonzero(~top)
    ask = ask[np.unique(_keyed((t["pr"][ask], t["pl"][ask]))[0], return_index=True)[1]]
    out = [(to, {"parent": x}) for to, x in by_home(home(t["pr"][ask], count), r=t["pr"][ask], l=t["pl"][ask])]
    return st, out, (int((~top).sum()),)


def descend(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """What has been decided is told to the blocks with children, once."""
    t, ask, told = st["table"], gathered(inbox, "parent"), gathered(inbox, "owner")
    if ask:
        st["waiting"] = {k: ask[k] for k in ("r", "l", "src")}
    if told:
        at, hit = _matched((told["r"], told["l"]), (t["pr"], t["pl"]))
        now = hit & ~st["done"]
        over = now & told["has"][at]
        st["or"], st["ol"] = np.where(over, told["or"][at], st["or"]), np.where(over, told["ol"][at], st["ol"]).astype(np.int16)
        st["has"], st["done"] = st["has"] | over, st["done"] | now
    out: Out = []
    w = st.get("waiting")
    if w is not None and len(w["r"]):
        at, _ = _matched((t["cr"], t["cl"]), (w["r"], w["l"]))
        ready = st["done"][at]
        g = at[ready]
        out = [(to, {"owner": x}) for to, x in by_home(w["src"][ready], r=w["r"][ready], l=w["l"][ready], **{"or": st["or"][g], "ol": st["ol"][g], "has": st["has"][g]})]
        st["waiting"] = _rows(w, ~ready)
    return st, out, (int((~st["done"]).sum()),)


def claim(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """Placed nodes ask for the cluster of their first chain."""
    x = st["placed"]
    number, first = np.unique(_keyed((x["cr"], x["cl"]))[0], return_index=True)
    return st, [(to, {"which": m}) for to, m in by_home(home(x["cr"][first], count), r=x["cr"][first], l=x["cl"][first])], ()


def grant(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    ask, t = gathered(inbox, "which"), st["table"]
    if not ask:
        return st, [], ()
    at, _ = _matched((t["cr"], t["cl"]), (ask["r"], ask["l"]))
    some = st["has"][at]
    at = at[some]
    return st, [(to, {"mine": m}) for to, m in by_home(ask["src"][some], r=ask["r"][some], l=ask["l"][some], **{"or": st["or"][at], "ol": st["ol"][at]})], ()


def least(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    """The smallest node seen here of each cluster."""
    mine, x = gathered(inbox, "mine"), st["placed"]
    if not mine:
        st["placed"] = _rows(x, np.zeros(len(x["id"]), bool))
        return st, [], ()
    at, hit = _matched((mine["r"], mine["l"]), (x["cr"], x["cl"]))
    x = {"id": x["id"][hit], "level": x["level"][hit], "cr": mine["or"][at[hit]], "cl": mine["ol"][at[hit]]}
    st["placed"] = x
    order = np.lexsort((x["id"], _keyed((x["cr"], x["cl"]))[0]))
    number = _keyed((x["cr"], x["cl"]))[0][order]
    first = np.ones(len(order), bool)
    first[1:] = number[1:] != number[:-1]
    at = order[first]
    return st, [(to, {"low": m}) for to, m in by_home(home(x["cr"][at], count), r=x["cr"][at], l=x["cl"][at], id=x["id"][at])], ()


def name(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    m = gathered(inbox, "low")
    if not m:
        return st, [], ()
    number = _keyed((m["r"], m["l"]))[0]
    low = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, number, m["id"])
    return st, [(to, {"name": x}) for to, x in by_home(m["src"], r=m["r"], l=m["l"], id=low[number])], ()


def label(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    m, x = gathered(inbox, "name"), st["placed"]
    label = np.empty(0, np.int64)
    if m:
        at, _ = _matched((m["r"], m["l"]), (x["cr"], x["cl"]))
        label = m["id"][at]
    return {"id": x["id"], "cluster": label, "level": x["level"].astype(np.int32), "forest": st["forest"]}, [], ()


def select(blocks: Blocks | LocalBlock) -> None:
    """The program that turns chains into clusters and labels the nodes."""
    blocks.step(house)
    left = sum(s[0] for s in blocks.step(choose))
    while left:
        left = sum(s[0] for s in blocks.step(descend))
    for fn in (claim, grant, least, name, label):
        blocks.step(fn)


def nothing(block: int, count: int, st: dict, inbox: list) -> tuple[dict, Out, tuple]:
    none = np.empty(0, np.int64)
    return {"id": none, "cluster": none, "level": none.astype(np.int32), "forest": _empty("forest")}, [], ()
