"""Neighbour tables (``i, nn_rank, idx, dist``), the graphs made of them and their communities.

Null ids or distances take no part; repeated rows count once where stated; ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .moves import contracted, contracted_here

#: Queries compared with one pass over the points.
QUERY_BLOCK = 20_000
#: Edges up to which one task finds the communities; larger graphs are contracted in blocks before.
GRAPH_EDGES = 2_000_000
#: Edges up to which nodes move one after the other; a task that holds more contracts them before by moves of many at once.
SINGLE_MOVES = 200_000

METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda q, p: np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T, 0)),
    "cosine": lambda q, p: 1 - (q @ p.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None], 1e-300),
    "manhattan": lambda q, p: np.stack([np.abs(p - r).sum(1) for r in q]),
    "hamming": lambda q, p: np.stack([(p != r).sum(1) for r in q]).astype(float),
}


def exact_neighbours(points: DataFrame, k: int = 10, metric: str = "euclidean", queries: DataFrame | None = None, blocks: int = 1) -> DataFrame:
    """The k nearest points of each query (``id, vec``), itself included if it is a point.

    Queries are compared in ``blocks`` passes of at most QUERY_BLOCK rows; each task ranks its own
    points, and only k candidates a query and task are shuffled."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    asked = points if queries is None else queries
    spark, out = points.sparkSession, None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked
        t = block.select("id", F.col("vec").cast("array<double>").alias("vec")).limit(QUERY_BLOCK + 1).toArrow()
        if t.num_rows > QUERY_BLOCK:
            raise ValueError("more blocks are needed")
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((t.column("id").to_numpy(), np.array(t.column("vec").to_pylist(), float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                p_ids, p = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), float)
                for a in range(0, len(q), 512):
                    d = METRICS[metric](q[a : a + 512], p)
                    d[q_ids[a : a + 512, None] == p_ids[None]] = 0  # rounding leaves no distance to itself
                    order = np.lexsort((np.broadcast_to(p_ids, d.shape), d), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[a : a + 512], order.shape[1])), pa.array(p_ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=["i", "idx", "dist"])

        part = points.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "i bigint, idx bigint, dist double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "i bigint, nn_rank int, idx bigint, dist double")
    w = Window.partitionBy("i").orderBy("dist", (F.col("idx") != F.col("i")), "idx")
    return out.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k).select("i", "nn_rank", "idx", "dist")


def approximate_neighbours(points: DataFrame, k: int = 10, metric: str = "euclidean", lists: int | None = None, probes: int = 8, sample_rows: int = 20_000, seed: int = 3) -> DataFrame:
    """``i, nn_rank, idx, dist`` like ``exact_neighbours`` for every point, from inverted lists.

    Centres are fit by a few rounds of k-means on at most ``sample_rows`` points; each point is in
    the list of its nearest centre and is compared with the points of the ``probes`` nearest lists.
    By default a list holds about 1,000 points as long as the sample has 16 points a centre."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {sorted(METRICS)}")
    spark = points.sparkSession
    p = points.where("id is not null and vec is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n = p.count()
    if not n:
        return spark.createDataFrame([], "i bigint, nn_rank int, idx bigint, dist double")
    sample = np.array(p.select("vec").sample(min(1.0, 1.2 * sample_rows / n), seed=seed).limit(sample_rows).toArrow().column("vec").to_pylist() or p.select("vec").limit(1).toArrow().column("vec").to_pylist(), float)
    count = max(1, min(lists or round(n / 1000), len(sample) // 16 or 1))
    centres = sample[np.random.default_rng(seed).choice(len(sample), count, replace=False)]
    for _ in range(8 if count > 1 else 0):
        near = np.concatenate([METRICS[metric](sample[a : a + 2000], centres).argmin(axis=1) for a in range(0, len(sample), 2000)])
        size = np.bincount(near, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    shared, probes = spark.sparkContext.broadcast(centres), min(probes, count)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                d = METRICS[metric](np.array(part.column("vec").to_pylist(), float), shared.value)
                to = np.argsort(d, axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(part.num_rows), probes))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), pa.array((np.arange(to.size) % probes == 0)), part.column("id").take(rows), part.column("vec").take(rows)], names=["list", "own", "id", "vec"])

    def rank(group: pa.Table) -> pa.Table:
        ids, x, own = group.column("id").to_numpy(), np.array(group.column("vec").to_pylist(), float), group.column("own").to_numpy()
        p_ids, held, out = ids[own], x[own], []
        for a in range(0, len(ids), 512):
            if not len(p_ids):
                break
            d = METRICS[metric](x[a : a + 512], held)
            d[ids[a : a + 512, None] == p_ids[None]] = 0
            order = np.lexsort((np.broadcast_to(p_ids, d.shape), d), axis=1)[:, :k]
            out.append((np.repeat(ids[a : a + 512], order.shape[1]), p_ids[order].ravel(), np.take_along_axis(d, order, 1).ravel()))
        i, j, d = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"i": i, "idx": j, "dist": d})

    found = p.mapInArrow(route, "list int, own boolean, id bigint, vec array<double>").groupBy("list").applyInArrow(rank, "i bigint, idx bigint, dist double")
    w = Window.partitionBy("i").orderBy("dist", (F.col("idx") != F.col("i")), "idx")
    return found.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k).select("i", "nn_rank", "idx", "dist")


def knn_to_graph(knn: DataFrame, use_weights: bool = False, self_loops: bool = True) -> DataFrame:
    """``i, j, weight``: a directed edge to each neighbour."""
    g = knn.where("i is not null and idx is not null").select("i", F.col("idx").alias("j"), (F.col("dist") if use_weights else F.lit(1.0)).alias("weight"))
    return g if self_loops else g.where("i <> j")


def knn_to_snn(knn: DataFrame, k: int, min_val: float = 1 / 15, self_loops: bool = False) -> DataFrame:
    """``i >= j, weight``: the share c / (2k - c) of common neighbours of two rows, if at least
    ``min_val``."""
    least = -(-(2 * k * min_val) // (1 + min_val))
    e = knn.where("i is not null and idx is not null").select("i", "idx").distinct()
    pairs = e.alias("a").join(e.alias("b"), "idx").where("a.i > b.i").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    out = pairs.where(F.col("c") >= least).select("i", "j", (F.col("c") / (2 * k - F.col("c"))).alias("weight"))
    if self_loops:
        out = out.unionByName(e.select("i", F.col("i").alias("j"), F.lit(1.0).alias("weight")).distinct())
    return out


def _fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Membership strengths of each row's neighbours: the bandwidth that makes them sum to log2(k)
    is found for all rows of one length together."""
    for batch in batches:
        lists = batch.column(1)
        offsets, flat = np.asarray(lists.offsets), lists.values
        own, idx, dist = batch.column(0).to_numpy(), flat.field("idx").to_numpy(), flat.field("dist").to_numpy()
        sizes = np.diff(offsets)
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            at = offsets[rows][:, None] + np.arange(k)
            j, d, i = idx[at], dist[at], own[rows]
            rho = np.where((j != i[:, None]) & (d > 0), d, np.inf).min(axis=1)
            over = np.maximum(d - rho[:, None], 0.0)
            over[np.isinf(rho)] = 0.0
            counted = np.ones_like(d, dtype=bool)
            counted[:, 0] = j[:, 0] != i
            low, high, sigma = np.zeros(len(rows)), np.full(len(rows), np.inf), np.ones(len(rows))
            moving = np.ones(len(rows), dtype=bool)
            for _ in range(64):
                total = np.where(counted, np.exp(-over / sigma[:, None]), 0).sum(axis=1)
                moving &= np.abs(total - np.log2(k)) >= 1e-5
                if not moving.any():
                    break
                up = total > np.log2(k)
                high, low = np.where(moving & up, sigma, high), np.where(moving & ~up, sigma, low)
                step = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
                sigma = np.where(moving, step, sigma)
            sigma = np.maximum(sigma, 1e-3 * d.mean(axis=1))
            w = np.exp(-over / np.where(sigma > 0, sigma, 1)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, k)), pa.array(j.ravel()), pa.array(w.ravel())], names=["i", "j", "weight"])


def knn_to_geodesic(knn: DataFrame) -> DataFrame:
    """``i > j, weight`` of the fuzzy neighbour graph; two directions combine as a + b - ab."""
    rows = knn.where("i is not null and idx is not null and dist is not null").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("nn_rank", "idx", "dist"))).alias("x"))
    e = rows.mapInArrow(_fuzzy, "i bigint, j bigint, weight double").where("i <> j and weight > 0")
    w = e.groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.sum("weight").alias("s"), F.min("weight").alias("a"), F.max("weight").alias("b"), F.count(F.lit(1)).alias("n"))
    return w.select("i", "j", F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def _moves(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float, rng, cpm: bool, size: np.ndarray) -> np.ndarray:
    """Local moves to the best neighbouring community until none gains."""
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    ww = np.concatenate([w, w])
    order = np.argsort(a, kind="stable")
    a, b, ww = a[order], b[order], ww[order]
    at = np.searchsorted(a, np.arange(n + 1))
    strength = size.astype(float) if cpm else np.bincount(a, weights=ww, minlength=n)
    total = 1.0 if cpm else max(ww.sum(), 1e-300)
    com, mass = np.arange(n), strength.copy()
    for _ in range(20):
        moved = 0
        for x in rng.permutation(n):
            links: dict[int, float] = {}
            for k in range(at[x], at[x + 1]):
                if b[k] != x:
                    links[com[b[k]]] = links.get(com[b[k]], 0.0) + ww[k]
            own = com[x]
            mass[own] -= strength[x]
            pull = lambda c: links.get(c, 0.0) - resolution * strength[x] * mass[c] / total
            best, gain = own, pull(own)
            for c in sorted(links):
                if (g := pull(c)) > gain + 1e-12:
                    best, gain = c, g
            mass[best] += strength[x]
            moved += best != own
            com[x] = best
        if not moved:
            break
    return np.unique(com, return_inverse=True)[1]


def _split_connected(com: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Communities split into their connected parts."""
    parent = np.arange(len(com))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(u, v):
        if com[x] == com[y]:
            parent[find(x)] = find(y)
    return np.unique([find(x) for x in range(len(com))], return_inverse=True)[1]


def _communities(resolution: float, seed: int, cpm: bool, connected: bool):
    def run(group: pa.Table) -> pa.Table:
        i, j, w, within = (group.column(c).to_numpy() for c in ("i", "j", "weight", "size"))
        labels, nodes = None, 0
        while len(i) > SINGLE_MOVES:
            level, (i, j, w, within) = contracted_here(i, j, w, within, resolution, cpm, connected, seed)
            labels = level if labels is None else (labels[0], level[1][np.searchsorted(level[0], labels[1])])
            fewer, nodes = (within > 0).sum() != nodes, (within > 0).sum()
            if not fewer:
                break
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        u, v = at[: len(i)], at[len(i) :]
        rng, owner, n = np.random.default_rng(seed), np.arange(len(ids)), len(ids)
        size = np.bincount(u, weights=within, minlength=n).astype(np.int64)
        cu, cv, cw, size = u, v, w, np.where(size > 0, size, 1)
        while True:
            com = _moves(n, cu, cv, cw, resolution, rng, cpm, size)
            if connected:
                com = _split_connected(com, cu, cv)
            m = com.max() + 1
            owner = com[owner]
            if m == n:
                break
            size = np.bincount(com, weights=size, minlength=m).astype(np.int64)
            a, b = np.minimum(com[cu], com[cv]), np.maximum(com[cu], com[cv])
            key, back = np.unique(a.astype(np.int64) * m + b, return_inverse=True)
            cw, cu, cv, n = np.bincount(back, weights=cw), key // m, key % m, m
        if labels is not None:
            ids, owner = labels[0], owner[np.searchsorted(ids, labels[1])]
        low = np.full(owner.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, owner, ids)
        return pa.table({"id": ids, "community": low[owner]})

    return run


def communities(graph: DataFrame, resolution: float = 1.0, objective: str = "modularity", seed: int = 12531, method: str = "leiden") -> DataFrame:
    """``id, community`` (its smallest id) of an undirected graph ``i, j, weight``, by local moves
    and contraction with a fixed seed; ``leiden`` also keeps communities connected.  A graph of up
    to GRAPH_EDGES rows is held by one executor task; a larger one is first contracted by moves over
    blocks (``operators.moves``) until it is that small, or until no move gains."""
    if objective not in ("modularity", "CPM") or method not in ("leiden", "louvain"):
        raise ValueError("unknown objective or method")
    cpm, connected = objective == "CPM", method == "leiden"
    usable = graph.where("i is not null and j is not null and i <> j and weight > 0")
    e = usable.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("weight").cast("double").alias("weight"), F.lit(0).cast("bigint").alias("size"))
    rows, largest = usable.agg(F.count(F.lit(1)), F.max(F.greatest(F.abs("i"), F.abs("j")))).first()
    labels, fewer = None, True
    while rows > GRAPH_EDGES and fewer:
        level, e, fewer = contracted(e, rows, largest, resolution, cpm, connected, seed)
        e = cut_lineage(e)
        rows = e.count()
        labels = level if labels is None else labels.join(level.toDF("community", "__next"), "community").select("id", F.col("__next").alias("community"))
    if rows <= GRAPH_EDGES:
        if labels is None:
            e = e.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("weight").alias("weight"), F.max("size").alias("size"))
        last = e.withColumn("__one", F.lit(1)).groupBy("__one").applyInArrow(_communities(resolution, seed, cpm, connected), "id bigint, community bigint")
        if labels is None:
            return last
        labels = labels.join(last.toDF("community", "__next"), "community").select("id", F.col("__next").alias("community"))
    low = labels.groupBy("community").agg(F.min("id").alias("__low"))
    return labels.join(low, "community").select("id", F.col("__low").alias("community"))


def cluster_seurat(graph: DataFrame, resolution: float = 0.8, seed: int = 12531) -> DataFrame:
    """Communities by plain local moves at the resolution usual in that tool."""
    return communities(graph, resolution, seed=seed, method="louvain")


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``modularity`` of a labelling ``id, community``."""
    e = graph.where("i <> j").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("weight").alias("w"))
    li, lj = labels.select(F.col("id").alias("i"), F.col("community").alias("ci")), labels.select(F.col("id").alias("j"), F.col("community").alias("cj"))
    t = e.join(li, "i").join(lj, "j")
    total = t.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("inside"))
    degree = t.select(F.col("ci").alias("c"), "w").unionByName(t.select(F.col("cj").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return degree.agg(F.sum(F.col("d") * F.col("d")).alias("dd")).crossJoin(F.broadcast(total)).select((F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def cluster_cells(points: DataFrame, knn: Callable[[DataFrame], DataFrame], graph: Callable[[DataFrame], DataFrame], cluster: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps from vectors to communities; each can be exchanged (see ``functools.partial``)."""
    return cluster(graph(knn(points)))
