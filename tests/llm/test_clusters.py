import numpy as np

from strandloom.llm.blocks import LocalBlock
from strandloom.llm.clusters import density_clusters, describe_clusters, spanning_forest
from strandloom.llm.contract import begin, levels, select

from .condense import condensed_clusters
from .condense import spanning_forest as kruskal


def planted(seed=0, sizes=(12, 30, 60), degree=6):
    rng = np.random.default_rng(seed)
    rows, owner, at = [], {}, 0
    for s in sizes:
        ids = np.arange(at, at + s) * 3 + 1
        at += s
        owner |= {int(i): int(ids[0]) for i in ids}
        for k, i in enumerate(ids):
            for j in rng.choice(np.delete(ids, k), degree, replace=False):
                rows.append((int(max(i, j)), int(min(i, j)), float(rng.uniform(0.2, 1))))
    ids = list(owner)
    for _ in range(12):  # stray edges
        a, b = rng.choice(ids, 2, replace=False)
        rows.append((int(a), int(b), 0.9))
    rows += [(9001, 9002, 1.0), (9002, 9003, 1.0), (9001, 9003, 1.0)]  # too few to be a cluster
    rows += [(1, 1, 1.0), (None, 4, 1.0), (4, 7, None), (4, 9001, float("nan")), (4, 9001, 0.0), (4, 9001, 1.5)]
    rows += [(b, a, w) for a, b, w in rows[:20]] + rows[:20]
    return rows, owner


def test_planted_clusters(spark):
    rows, owner = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "i long, j long, weight double, id string").repartition(3)
    nodes = density_clusters(df)
    assert {r.id: r.cluster_id for r in nodes.collect()} == owner
    seen = {r.cluster_id: r for r in describe_clusters(nodes).collect()}
    assert {c: r.n_members for c, r in seen.items()} == {1: 12, 37: 30, 127: 60}
    assert all(len(r.exemplars) == 3 and {owner[x] for x in r.exemplars} == {c} for c, r in seen.items())
    assert density_clusters(df.limit(0)).count() == 0
    assert density_clusters(df.where("i = j")).count() == 0


def contracted(a, b, s, level, min_size):
    """Forest and labels by the rounds, within one block."""
    nodes = np.unique(np.concatenate([a, b]))
    only = LocalBlock({"nodes": nodes, "a": a, "b": b, "s": s.astype(np.float32), "level": level.astype(np.int16)}, [])
    top = only.step(begin, True)[0][0]
    levels(only, top, min_size, 1000)
    select(only)
    st = only.state
    return set(zip(st["forest"]["a"].tolist(), st["forest"]["b"].tolist())), {int(i): (int(c), int(x)) for i, c, x in zip(st["id"], st["cluster"], st["level"])}


def test_rounds_equal_sequential_hierarchy():
    rng = np.random.default_rng(7)
    for trial in range(30):
        pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 20 + 4 * trial, (30 + 8 * trial, 2)).tolist() if p[0] != p[1]})
        a, b = (np.array(x) for x in zip(*pairs))
        s = rng.integers(0, 12, len(a)) / 16
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        keep = kruskal(u, v, np.lexsort((b, a, -s)), len(ids))
        level = np.floor(s * 12).astype(int)
        label, finest = condensed_clusters(u[keep], v[keep], level[keep], len(ids), 4)
        forest, labels = contracted(a, b, s, level, 4)
        assert forest == {(int(a[k]), int(b[k])) for k in keep}
        assert labels == {int(ids[k]): (int(ids[label[k]]), int(finest[k])) for k in range(len(ids)) if label[k] >= 0}


def test_many_blocks_equal_one(spark):
    """Also a hub, whose links are spread over all blocks."""
    rows, _ = planted(3, (40, 60, 90))
    rows += [(1, 3 * k + 1, 0.01) for k in range(1, 190)]
    df = spark.createDataFrame(rows, "i long, j long, weight double")
    one, many = (sorted(map(tuple, density_clusters(df, block_rows=n).collect())) for n in (10**6, 500))
    assert one == many and len(one) > 150
    one, many = (sorted((r.a, r.b) for r in spanning_forest(df, block_rows=n).collect()) for n in (10**6, 500))
    assert one == many


def test_large_sparse_cluster(spark):
    """One sparse cluster of a third of all nodes, whose walks mix in about twice the rounds of the others."""
    rng = np.random.default_rng(5)
    sizes = [4000] + [100] * 80
    starts = np.cumsum([0, *sizes])
    rows = [(int(at + k), int(at + j), float(w)) for at, s in zip(starts, sizes) for k in range(s) for j, w in zip(rng.integers(0, s, 3), rng.uniform(0.2, 1, 3))]
    rows += [(int(a), int(b), 0.9) for a, b in rng.integers(0, starts[-1], (1200, 2))]  # stray edges
    got = {r.id: r.cluster_id for r in density_clusters(spark.createDataFrame(rows, "i long, j long, weight double")).collect()}
    assert sum(got.get(k) == 0 for k in range(4000)) > 0.98 * 4000
    owner = np.repeat(starts[:-1], sizes)
    assert sum(got.get(k) == owner[k] for k in range(4000, len(owner))) > 0.98 * 8000
