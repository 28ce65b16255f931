import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.forest import Forest, nearest_in_block
from strandloom.llm.vectors import nearest_vectors, neighbour_pairs

SCHEMA = "vec_id long, vec array<float>, dist string"


def brute(rows, dim, k):
    best = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            v = tuple(np.float32(x) for x in v)
            best[i] = min(best.get(i, v), v)
    ids = sorted(best)
    x = np.array([best[i] for i in ids], np.float64)
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        out[i] = [(j, pytest.approx(dj, abs=1e-6)) for dj, j in sorted((d[b], j) for b, j in enumerate(ids) if j != i)[:k]]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("i", "nn_rank").collect():
        got.setdefault(r.i, []).append((r.idx, r.dist))
    return got


def test_exact_where_leaves_hold_all(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), "x") for i in range(60)]  # many ties and copies
    rows += [(100 + i, [9.0, 9.0, 9.0, 9.0], "x") for i in range(30)]  # a large group of copies
    rows += rows[:5] + [(200, None, ""), (201, [1.0], ""), (202, [1.0, None, 2.0, 3.0], ""), (203, [float("nan")] * 4, ""), (204, [float("inf")] * 4, ""), (None, [1.0] * 4, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 4, 5)
    assert collected(nearest_vectors(df, dim=4, k=5)) == want
    some = collected(nearest_vectors(df, dim=4, k=5, queries=F.col("id") % 7 == 0))
    assert some == {i: v for i, v in want.items() if i % 7 == 0}
    pairs = {tuple(r) for r in neighbour_pairs(nearest_vectors(df, dim=4, k=5)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, v in want.items() for j, _ in v}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], ""), (2, [1.0, 0.0], "")], SCHEMA)
    assert collected(nearest_vectors(df, dim=2)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert nearest_vectors(df.limit(1), dim=2).count() == 0
    assert nearest_vectors(df.limit(0), dim=2).count() == 0


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 3
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = collected(nearest_vectors(df, dim=16, queries=F.col("id") % 20 == 0, leaf_rows=250))
    ids = np.arange(4000)
    true, _ = nearest_in_block(x[::20], x, ids[::20], ids, 10)
    hits = sum(len(set(t) & {j for j, _ in got[i]}) for i, t in zip(ids[::20].tolist(), true.tolist()))
    assert len(got) == 200 and hits >= 0.9 * 2000


def test_queue_equals_full_ranking():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    f = Forest(x, 2, 4)
    inner = 15
    for q, got in zip(x[:40], f.probe(x[:40], 9)):
        ranks = []
        for t in range(2):
            for leaf in range(16):
                node, rank = 0, 0.0
                for bit in range(3, -1, -1):
                    right = leaf >> bit & 1
                    m = float(q @ f.normal[t * inner + node] - f.offset[t * inner + node])
                    rank = rank if (m > 0) == bool(right) else min(rank, -abs(m))
                    node = 2 * node + 1 + right
                ranks.append((-rank, t * 16 + leaf))
        rank_of = {k: r for r, k in ranks}  # leaves below one far node share its priority
        assert len(set(got.tolist())) == 9
        assert sorted(rank_of[k] for k in got.tolist()) == pytest.approx(sorted(r for r, _ in ranks)[:9], abs=1e-5)


@pytest.mark.parametrize("slice_rows", [16, 0.5])
def test_leaves_split_again_and_given_out_in_slices(spark, monkeypatch, slice_rows):
    """A small sample leaves large leaves, which trees of their own vectors split."""
    monkeypatch.setattr("strandloom.llm.vectors.SLICE", slice_rows)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8)) * 3
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], SCHEMA)
    got = collected(nearest_vectors(df, dim=8, queries=F.col("id") % 20 == 0, leaf_rows=60, sample_rows=130))
    hits = 0
    for i in range(0, 3000, 20):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {j for j, _ in got[i]})
        assert len(got[i]) == 10 and len({j for j, _ in got[i]}) == 10
    assert hits / 1500 > 0.9
