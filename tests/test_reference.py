"""The engine's own operators against literal examples, dense arrays and recomputation."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions.tails import benjamini_hochberg, poisson_cdf_value, poisson_quantile_value
from strandloom.operators import atac, fragments, graph, linalg, matrix, overlap, plotdata, ranges, stats
from strandloom.operators.matrix import SparseMatrix

FRAGS = "chr string, start int, end int, cell_id string"


def frags_x1(spark, shift=0, repeat=True):
    rows = [("chr1", s + shift, 1001 + i, f"cell{i}") for i in range(1, 6) for s in range(i, 6) for _ in range(i if repeat else 1)]
    rows += [("chr2", 9, 21, "cell1"), ("chr2", 9, 20, "cell2"), ("chr2", 10, 21, "cell3"), ("chr2", 10, 20, "cell4")]
    return spark.createDataFrame(rows, FRAGS)


def dense(df, row, rows, cells=5):
    got = {(r[row], r.cell_id): r.n for r in df.collect()}
    return [[got.get((k, f"cell{c}"), 0) for c in range(1, cells + 1)] for k in rows]


def test_peak_matrix_modes(spark):
    f = frags_x1(spark)
    peaks = spark.createDataFrame([(0, "chr2", 10, 20), (1, "chr1", 3, 5), (2, "chr1", 1002, 1005), (3, "chr1", 1004, 1006)], "peak_id int, chr string, start int, end int")
    want = {
        "insertions": [[0, 1, 1, 2, 0], [2, 4, 6, 4, 0], [0, 8, 9, 8, 0], [0, 0, 0, 8, 5]],
        "fragments": [[0, 1, 1, 1, 0], [2, 4, 6, 4, 0], [0, 8, 9, 8, 0], [0, 0, 0, 8, 5]],
        "overlaps": [[1, 1, 1, 1, 0], [4, 6, 6, 4, 0], [0, 8, 9, 8, 5], [0, 0, 0, 8, 5]],
    }
    for mode, w in want.items():
        assert dense(overlap.peak_matrix(f, peaks, mode), "peak_id", range(4)) == w, mode
    assert overlap.peak_matrix(f.limit(0), peaks).count() == 0 and overlap.peak_matrix(f, peaks.limit(0), "overlaps").count() == 0


def test_tile_matrix(spark):
    f = frags_x1(spark, 400, False)
    regions = spark.createDataFrame([("a", "chr2", 10, 20, 4), ("b", "chr1", 3, 5, 1), ("c", "chr1", 402, 405, 2), ("d", "chr1", 1004, 1006, 2)], "region_id string, chr string, start int, end int, tile_width int")
    got = {(r.region_id, r.tile_no, r.cell_id): r.n for r in overlap.tile_matrix(f, regions).collect()}
    rows = [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("d", 0)]
    assert [[got.get((*k, f"cell{c}"), 0) for c in range(1, 6)] for k in rows] == [[0, 0, 1, 1, 0], [0] * 5, [0, 1, 0, 1, 0], [0] * 5, [0] * 5, [2, 2, 1, 0, 0], [1, 1, 1, 1, 0], [0, 0, 0, 2, 1]]
    # a fragment whose ends lie in two tiles of one region counts its start only
    one = spark.createDataFrame([("chr2", 10, 20, "x")], FRAGS)
    assert [(r.tile_no, r.n) for r in overlap.tile_matrix(one, regions, "fragments").collect()] == [(0, 1)]
    tiles = sorted((r.region_id, r.tile_no, r.start, r.end) for r in ranges.tile_ranges(regions).collect())
    assert tiles[:3] == [("a", 0, 10, 14), ("a", 1, 14, 18), ("a", 2, 18, 20)]


def test_range_join_all_widths(spark):
    rnd = random.Random(1)
    rand = lambda n: [(k, rnd.choice(["chr1", "chr2"]), s := rnd.randrange(3_000_000), s + rnd.choice([1, 50, 5000, 60_000, 2_000_000, 900_000_000])) for k in range(n)]
    a, b = rand(80), rand(60)
    schema = "id int, chr string, start int, end int"
    da = spark.createDataFrame(a + [(900, None, 1, 5), (901, "chr1", None, 5), (902, "chr1", 7, 7)], schema)
    db = spark.createDataFrame(b, schema)
    got = Counter((r.id, r.r_id) for r in ranges.range_join(da, db).collect())
    want = Counter((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])
    assert got == want
    hit = {r.id for r in ranges.select_overlapping(da, db.where("id < 3")).collect()}
    assert hit == {x[0] for x in a for y in b[:3] if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    points = spark.createDataFrame([(k, x[1], x[2]) for k, x in enumerate(a)], "id int, chr string, pos int")
    got = Counter((r.id, r.r_id) for r in ranges.points_in_ranges(points, "pos", db).collect())
    assert got == Counter((k, y[0]) for k, x in enumerate(a) for y in b if x[1] == y[1] and y[2] <= x[2] < y[3])


def test_greedy_merge(spark):
    for starts, keep in (([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [1, 3, 5, 7, 9]), ([1, 22, 11, 22, 2, 3, 13, 1, 4, 21, 12], [1, 22, 11, 3, 13])):
        df = spark.createDataFrame([("chr1", s, s + 2, k) for k, s in enumerate(starts)], "chr string, start int, end int, r int")
        assert [r.start for r in ranges.merge_ranked(df, "r").orderBy("r").collect()] == keep


def test_nearest_and_extend(spark):
    rows = [(k, "chr1", 10 + 100 * k, 60 + 100 * k, True) for k in range(5)]
    schema = "gene_id int, chr string, start int, end int, strand boolean"
    up = {r.gene_id: (r.upstream, r.downstream) for r in ranges.distance_to_nearest(spark.createDataFrame(rows + [(9, "chr1", 11, 20, True)], schema), "gene_id").collect()}
    inf = math.inf
    assert up == {0: (inf, 51), 1: (51, 51), 2: (51, 51), 3: (51, 51), 4: (51, inf), 9: (0, 0)}
    g = spark.createDataFrame([(1, "chr1", 1000, 1500, True), (2, "chr2", 2000, 2500, False)], schema)
    ext = {r.gene_id: (r.start, r.end) for r in ranges.extend_ranges(g, 10, 100).collect()}
    assert ext == {1: (990, 1600), 2: (1900, 2510)}
    texts = spark.createDataFrame([("chr1:1,001-2000",), ("bad",), (None,)], "range string")
    assert [(r.chr, r.start, r.end) for r in ranges.normalize_ranges(texts).collect()] == [("chr1", 1000, 2000), (None, None, None), (None, None, None)]


def test_nearest_of_piled_ranges(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["chr1", "chr2", None]), s := rng.choice([None, *range(40)]), None if s is None else s + rng.randint(0, 9), rng.random() < 0.5) for k in [*range(60), *range(6), None, None]]
    df = spark.createDataFrame(rows, "gene_id int, chr string, start int, end int, strand boolean")
    ok = [r for r in rows if None not in r[:4] and r[3] > r[2]]
    holds = lambda y, x: y[0] != x[0] and y[1] == x[1] and y[2] <= x[2] and x[3] <= y[3] and (y[3] - y[2] > x[3] - x[2] or y[0] < x[0])
    nested = {x[0] for x in ok if any(holds(y, x) for y in ok)}
    got = ranges.distance_to_nearest(df, "gene_id").collect()
    assert Counter(r.gene_id for r in got) == Counter([*nested, *(r[0] for r in rows if r[0] not in nested)])
    assert all((r.upstream, r.downstream) == (0, 0) for r in got if r.gene_id in nested)
    pile = spark.range(150_000).selectExpr("id as gene_id", "'chr1' as chr", "id as start", "id + 50000 as end", "true as strand")
    out = ranges.distance_to_nearest(pile, "gene_id")  # billions of overlapping pairs
    assert "Join" not in out._jdf.queryExecution().toString() and out.where("upstream = 0 or downstream = 0").count() == 150_000


def test_footprint(spark):
    cells = spark.createDataFrame([(f"c{k}", f"grp{1 + k % 2}", w) for k, w in enumerate([1.0, 1.0, 2.0, 4.0])], "cell_id string, cell_group string, weight double")
    f = spark.createDataFrame([("chr1", 22, 28, "c0"), ("chr1", 24, 25, "c2"), ("chr2", 22, 26, "c1"), ("chr2", 23, 27, "c3")], FRAGS)
    motifs = spark.createDataFrame([("chr1", 24, 30, True), ("chr2", 20, 25, False)], "chr string, start int, end int, strand boolean")
    got = {(r.cell_group, r.position): r.n for r in overlap.footprint(f, motifs, cells, flank=4, normalization_width=1).collect()}
    assert len(got) == 18
    assert {k: v for k, v in got.items() if v} == {("grp1", -2): 1, ("grp1", 3): 1, ("grp1", 0): 4, ("grp2", 2): 1, ("grp2", -1): 1, ("grp2", 1): 4, ("grp2", -2): 4}


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 11, (14, 9)) * (rng.random((14, 9)) < 0.5) - (rng.random((14, 9)) < 0.1) * 2.0
    x[3], x[:, 4], x[5] = 0, 0, 7  # an empty row and column, a row without zeros
    x[5, 4] = 1
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(0, 0, 0.0)]
    return SparseMatrix.of(spark.createDataFrame(rows, "row long, col long, val double"), 14, 9), x


def test_indexes_and_names(spark, small):
    m, x = small
    for key in ((slice(2, 9), slice(None)), (Ellipsis, [3, 1]), ([True] * 4 + [False] * 10,), (slice(None, None, -2), slice(1, 5)), (-1, Ellipsis), 3):
        want = np.atleast_2d(x[key] if not isinstance(key, tuple) or not isinstance(key[0], list) else x[np.array(key[0])])
        assert np.allclose(to_array(m[key]), want), key
    for bad in ((99, 0), ([True],), (1, 2, 3)):
        with pytest.raises(IndexError):
            m[bad]
    names = spark.createDataFrame([(i, f"g{i % 13}") for i in range(14)], "idx long, name string")
    assert np.allclose(to_array(matrix.rows_by_name(m, ["g5", "g2"], names)), x[[5, 2]])
    with pytest.raises(KeyError):
        matrix.rows_by_name(m, ["g0"], names)
    cols = spark.createDataFrame([(0, "c0")], "idx long, name string")
    got = matrix.named_entries(m, names, cols).where("col_name = 'c0'").agg(F.sum("val")).first()[0]
    assert got == pytest.approx(x[:, 0].sum())
    sums = matrix.apply_by(m, "col", lambda i, r, v: {"s": float(v.sum()), "n": len(r)}, "s double, n int").orderBy("col").collect()
    assert np.allclose([r.s for r in sums], x.sum(0)) and [r.n for r in sums] == (x != 0).sum(0).tolist()
    dense = spark.createDataFrame([(j, [1.0 * j, 2.0]) for j in range(9)], "idx long, vector array<double>")
    assert np.allclose([r.vector for r in m.times_dense(dense, 2).orderBy("idx").collect()], x @ np.array([[j, 2.0] for j in range(9)]))
    genes = spark.createDataFrame([(i, 2.0, 0.1 * (i + 1)) for i in range(14)], "idx long, theta double, beta double")
    cells = spark.createDataFrame([(j, float(1 + j % 3)) for j in range(9)], "idx long, reads double")
    z = np.zeros((14, 9))
    for r in linalg.pearson_residuals(m, genes, cells, 0.04, (-2, 3)).collect():
        z[r.row, r.col] = r.val
    st = linalg.pearson_residual_stats(m, genes, cells, 0.04, (-2, 3)).orderBy("row").collect()
    assert np.allclose([r["mean"] for r in st], z.mean(1)) and np.allclose([r.variance for r in st], z.var(1, ddof=1))


def to_array(m):
    out = np.zeros((m.nrow, m.ncol))
    for r in m.densify().collect():
        out[r.row, r.col] = r.val
    return out


def test_matrix_operations(spark, small):
    m, x = small
    assert np.allclose(to_array(m), x)
    assert np.allclose(to_array(m.t), x.T)
    assert np.allclose(to_array(m.select([5, 0, -1], [8, 2])), x[[5, 0, 13]][:, [8, 2]])
    assert np.allclose(to_array(m.col_slice(2, 6)), x[:, 2:6])
    assert np.allclose(to_array(m.power(2)), x**2) and np.allclose(to_array(m.min_scalar(3)), np.minimum(x, 3))
    assert np.allclose(to_array(m.scale(0.3).round(0)), np.rint(x * 0.3)) and np.allclose(to_array(m > 4), x > 4)
    assert np.allclose(to_array(m.bind_rows(m)), np.vstack([x, x])) and np.allclose(to_array(m.bind_cols(m)), np.hstack([x, x]))
    assert np.allclose(to_array(m.t.multiply(m)), x.T @ x)
    y = x.copy()
    y[np.ix_([1, 3], [0, 4])] = x[np.ix_([5, 2], [1, 2])]
    assert np.allclose(to_array(m.assign([1, 3], [0, 4], m.select([5, 2], [1, 2]))), y)
    r = spark.createDataFrame([(i, i - 3.0) for i in range(14)], "idx long, v double")
    c = spark.createDataFrame([(i, 0.5 * i) for i in range(9)], "idx long, v double")
    s = m.add(2.0).add_by("row", r).add_by("col", c).scale(3)
    dense_s = 3 * (x + 2 + (np.arange(14) - 3.0)[:, None] + 0.5 * np.arange(9))
    assert np.allclose(to_array(s), dense_s)
    assert np.allclose([q.v for q in s.times_vector(c).orderBy("idx").collect()], dense_s @ (0.5 * np.arange(9)))
    for axis, ax in (("row", 1), ("col", 0)):
        got = stats.axis_stats(s, axis).orderBy(axis).collect()
        assert np.allclose([g["mean"] for g in got], dense_s.mean(ax)) and np.allclose([g.variance for g in got], dense_s.var(ax, ddof=1))
    for bad in (lambda: m < 3, lambda: m.binarize(0, False), lambda: m.select([1, 1]), lambda: s.log1p(), lambda: m.power(-1)):
        with pytest.raises(ValueError):
            bad()
    assert matrix.same(m, m.t.t).first()[0] and not matrix.same(m, m.scale(2)).first()[0]


@pytest.mark.parametrize("axis, ax", [("row", 1), ("col", 0)])
def test_statistics(spark, small, axis, ax):
    m, x = small
    got = stats.axis_stats(m, axis).orderBy(axis).collect()
    assert np.allclose([g.total for g in got], x.sum(ax)) and np.allclose([g.nonzero for g in got], (x != 0).sum(ax)) and np.allclose([g.variance for g in got], x.var(ax, ddof=1))
    assert np.allclose([g.max for g in stats.axis_max(m, axis).orderBy(axis).collect()], x.max(ax))
    names = {4: "interpolated_inverted_cdf", 5: "hazen", 6: "weibull", 7: "linear", 8: "median_unbiased", 9: "normal_unbiased"}
    for form, name in names.items():
        probs = [0.0, 0.1, 0.5, 0.77, 1.0]
        got = {(r[axis], r.prob): r.quantile for r in stats.axis_quantiles(m, axis, probs, form).collect()}
        want = np.quantile(x, probs, axis=ax, method=name)
        assert np.allclose([[got[k, p] for k in range(x.shape[1 - ax])] for p in probs], want), form


def test_ranks_and_markers(spark, small):
    m, x = small
    got = to_array(stats.rank_transform(m, "row"))
    def avg(v):
        return np.array([(np.sum(v < a) + 1 + np.sum(v <= a)) / 2 for a in v])
    for i in range(14):
        r = avg(x[i])
        zero = r[x[i] == 0][0] if (x[i] == 0).any() else 0
        assert np.allclose(got[i], r - zero)
    groups = spark.createDataFrame([(j, "ab"[j % 2]) for j in range(9)], "idx long, cell_group string")
    for row in stats.marker_features(m, groups).collect():
        mine = np.array([("ab"[j % 2] == row.cell_group) for j in range(9)])
        v = x[row.row]
        u = avg(v)[mine].sum() - mine.sum() * (mine.sum() + 1) / 2
        assert row.u == pytest.approx(u) and row.foreground_mean == pytest.approx(v[mine].mean()) and 0 <= row.p_val <= 1
    bulk = {(r.row, r.cell_group): r for r in stats.pseudobulk(m, groups).collect()}
    for (i, g), r in bulk.items():
        v = x[i, ["ab"[j % 2] == g for j in range(9)]]
        assert (r.nonzeros, r.total) == ((v != 0).sum(), pytest.approx(v.sum())) and r.variance == pytest.approx(v.var(ddof=1))


def test_factorisations(spark, small):
    m, x = small
    u, d, v = linalg.svds(m, 4)
    assert np.allclose(d, np.linalg.svd(x, compute_uv=False)[:4])
    ua, va = (np.array([r.vector for r in t.orderBy("idx").collect()]) for t in (u, v))
    assert np.allclose(ua.T @ ua, np.eye(4), atol=1e-8) and np.allclose(x @ va, ua * d)
    assert np.allclose(linalg.svds(m.t, 3)[1], d[:3])
    cov = spark.createDataFrame([(j, float(j * j % 5)) for j in range(9)], "idx long, c double")
    design = np.column_stack([np.ones(9), [j * j % 5 for j in range(9)]])
    want = x - (design @ np.linalg.lstsq(design, x.T, rcond=None)[0]).T
    for r in linalg.regress_out(m, cov).collect():
        assert r.val == pytest.approx(want[r.row, r.col], abs=1e-9)


def test_graphs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    knn = graph.exact_neighbours(df, 6, blocks=3)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    got = {}
    for r in knn.orderBy("i", "nn_rank").collect():
        got.setdefault(r.i, []).append(r.idx)
    assert all(got[i] == np.argsort(d[i])[:6].tolist() for i in range(60))
    a = np.zeros((60, 60))
    for i, js in got.items():
        a[i, js] = 1
    c = a @ a.T
    snn = {(r.i, r.j): r.weight for r in graph.knn_to_snn(knn, 6).collect()}
    w = np.tril(c / (12 - c), -1)
    assert {k: pytest.approx(v) for k, v in snn.items()} == {(int(i), int(j)): w[i, j] for i, j in zip(*np.nonzero(w >= 1 / 15))}
    geo = {(r.i, r.j): r.weight for r in graph.knn_to_geodesic(knn).collect()}
    assert all(i > j and 0 < v <= 1 + 1e-12 for (i, j), v in geo.items())
    first = {tuple(sorted((i, js[1]), reverse=True)) for i, js in got.items()}
    assert all(geo[k] == pytest.approx(1.0) for k in first)
    rows = [(int(s + i), int(s + j), 1.0) for s in (0, 10, 20) for i in range(6) for j in range(i)] + [(5, 10, 0.1), (15, 20, 0.1)]
    g = spark.createDataFrame(rows, "i long, j long, weight double")
    for method in ("leiden", "louvain"):
        lab = graph.communities(g, method=method)
        assert {r.id: r.community for r in lab.collect()} == {s + i: s for s in (0, 10, 20) for i in range(6)}
        assert graph.modularity(g, lab).first()[0] > 0.6
    with pytest.raises(ValueError):
        graph.exact_neighbours(df, metric="other")


@pytest.mark.parametrize("method", ["leiden", "louvain"])
def test_communities_of_graphs_above_a_task(spark, monkeypatch, method):
    from strandloom.operators import moves

    rng = np.random.default_rng(7)
    rows = [(c * 10 + int(i), c * 10 + int(j), float(rng.uniform(0.5, 1))) for c in range(40) for i in range(10) for j in range(i)]
    rows += [(int(i), int(j), 0.2) for i, j in rng.integers(0, 400, (120, 2))] + [(5, 5, 1.0), (j := 3, 2, 0.1)]
    df = spark.createDataFrame(rows + [(j, i, w / 2) for i, j, w in rows[:200]] + [(None, 4, 1.0), (2**40, 2**40 + 1, 1.0)], "i long, j long, weight double").repartition(3)
    whole = graph.modularity(df.where("i is not null"), graph.communities(df, method=method)).first()[0]
    monkeypatch.setattr(graph, "GRAPH_EDGES", 300)
    monkeypatch.setattr(moves, "BLOCK_LINKS", 2500)
    lab = graph.communities(df, method=method).collect()
    got = {r.id: r.community for r in lab}
    assert len(lab) == 402 == len(got) and all(got[c] == c <= k for k, c in got.items())
    assert sum(got[k] == got[k // 10 * 10] for k in range(400)) > 390 and got[2**40 + 1] == 2**40
    assert graph.modularity(df.where("i is not null"), spark.createDataFrame(lab)).first()[0] > 0.98 * whole


def test_seurat_above_a_task(spark, monkeypatch):
    rows = [(c * 8 + i, c * 8 + j, 1.0) for c in range(6) for i in range(8) for j in range(i)] + [(8 * c, 8 * c - 1, 0.1) for c in range(1, 6)]
    monkeypatch.setattr(graph, "GRAPH_EDGES", 100)
    lab = graph.cluster_seurat(spark.createDataFrame(rows, "i long, j long, weight double")).collect()
    assert {r.id: r.community for r in lab} == {k: k // 8 * 8 for k in range(48)}


@pytest.mark.parametrize("connected", [False, True])
def test_a_task_contracts_before_single_moves(monkeypatch, connected):
    rng = np.random.default_rng(3)
    edges = {(c * 10 + i, c * 10 + j): 1.0 for c in range(60) for i in range(10) for j in range(i)}
    edges |= {(int(i), int(j)): 0.05 for i, j in rng.integers(0, 600, (300, 2)) if i // 10 != j // 10}
    (i, j), w = np.array(list(edges)).T, np.array(list(edges.values()))
    swept, moved = [], graph._moves
    monkeypatch.setattr(graph, "_moves", lambda n, u, *x: swept.append(len(u)) or moved(n, u, *x))
    monkeypatch.setattr(graph, "SINGLE_MOVES", 500)
    lab = graph._communities(1.0, 5, False, connected)(pa.table({"i": i, "j": j, "weight": w, "size": np.zeros(len(i), np.int64)}))
    assert dict(zip(lab["id"].to_pylist(), lab["community"].to_pylist())) == {k: k // 10 * 10 for k in range(600)}
    assert max(swept) <= 500 < len(i)


@pytest.mark.parametrize("single", [40, 10**6])
def test_seurat_resolution_within_a_task(spark, monkeypatch, single):
    monkeypatch.setattr(graph, "SINGLE_MOVES", single)
    rows = [(i, j, 1.0 if i // 10 == j // 10 else 0.736) for i in range(20) for j in range(i)]
    df = spark.createDataFrame(rows, "i long, j long, weight double")
    assert {r.community for r in graph.cluster_seurat(df).collect()} == {0}  # joined below a resolution of 0.9
    assert {r.id: r.community for r in graph.communities(df, method="louvain").collect()} == {k: k // 10 * 10 for k in range(20)}


def test_moves_keep_the_links_apart(spark, monkeypatch):
    from strandloom.operators import moves

    written, step = [], moves.Blocks.step

    def seen(blocks, fn, *args, **kw):
        stats = step(blocks, fn, *args, **kw)
        written.extend(set(s) for _, (s, _) in blocks.rdd.collect())
        return stats

    monkeypatch.setattr(graph, "GRAPH_EDGES", 50)
    monkeypatch.setattr(moves, "BLOCK_LINKS", 100)
    monkeypatch.setattr(moves.Blocks, "step", seen)
    rows = [(c * 8 + i, c * 8 + j, 1.0) for c in range(4) for i in range(8) for j in range(i)] + [(8, 7, 0.1), (16, 15, 0.1), (24, 23, 0.1)]
    lab = graph.communities(spark.createDataFrame(rows, "i long, j long, weight double"), method="louvain").collect()
    assert {r.id: r.community for r in lab} == {k: k // 8 * 8 for k in range(32)}
    assert written and all(s == {"com", "fcom"} for s in written)  # links stay where they are


def test_moves_cut_their_lineage(spark, monkeypatch):
    from strandloom.operators import blocks, moves

    run, step = [], moves.Blocks.step

    def seen(held_by, fn, *args, **kw):
        before, stats = held_by.folder, step(held_by, fn, *args, **kw)
        run.append(1 if held_by.folder != before else run[-1] + 1 if run else 1)
        return stats

    monkeypatch.setattr(graph, "GRAPH_EDGES", 50)
    monkeypatch.setattr(moves, "BLOCK_LINKS", 100)
    monkeypatch.setattr(moves.Blocks, "step", seen)
    rows = [(c * 8 + i, c * 8 + j, 1.0) for c in range(4) for i in range(8) for j in range(i)] + [(8, 7, 0.1), (16, 15, 0.1), (24, 23, 0.1)]
    lab = graph.cluster_seurat(spark.createDataFrame(rows, "i long, j long, weight double")).collect()
    assert {r.id: r.community for r in lab} == {k: k // 8 * 8 for k in range(32)}
    assert len(run) > blocks.KEPT_STEPS >= max(run)  # plans of many steps overflow the stack of the scheduler


def test_tails(spark):
    assert poisson_cdf_value(3.7, 2.0) == pytest.approx(sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4)))
    assert [poisson_quantile_value(p, 2.0) for p in (0.1, 0.5, 0.99)] == [0, 2, 6]
    p = [0.01, 0.04, 0.03, 0.2]
    df = spark.createDataFrame([("g", k, v, 4) for k, v in enumerate(p)], "g string, k int, p double, n int")
    assert [r.q for r in benjamini_hochberg(df, ["g"], "p", "n").orderBy("k").collect()] == pytest.approx([0.04, 4 / 3 * 0.04, 4 / 3 * 0.04, 0.2])


def test_fragment_operators(spark):
    f = frags_x1(spark)
    assert fragments.identical(f, fragments.shift(fragments.shift(f, 1, 2), -1, -2)).first()[0]
    assert not fragments.identical(f, f.union(f.limit(1))).first()[0]
    with pytest.raises(ValueError):
        fragments.select_chromosomes(f, ["chr1", "chr1"])
    assert fragments.scan(f.limit(0)).first().n == 0
    both = fragments.merge_fragments([f.where("chr = 'chr1'"), f.where("chr = 'chr2'").withColumn("cell_id", F.lit("cell1"))])
    assert {"1_cell1", "2_cell1"} <= {r.cell_id for r in both.select("cell_id").distinct().collect()}
    hist = {r.length: r.n for r in fragments.length_histogram(f).collect()}
    assert hist == {10: 1, 11: 2, 12: 1}


def test_peak_calling_and_tracks(spark):
    rnd = random.Random(0)
    rows = [("chr1", s := rnd.randrange(100_000), s + 50, f"c{k % 7}") for k in range(400)] + [("chr1", 50_000 + k % 150, 50_100 + k % 40, f"c{k % 7}") for k in range(200)]
    f = spark.createDataFrame(rows, FRAGS)
    sizes = spark.createDataFrame([("chr1", 100_000)], "chr string, chr_size int")
    groups = spark.createDataFrame([(f"c{k}", "all") for k in range(7)], "cell_id string, cell_group string")
    for merge in ("none", "group", "all"):
        peaks = atac.call_peaks(f, sizes, groups, merge=merge).collect()
        assert peaks and all(49_700 < p.start < 50_300 and p.q_val < 0.01 for p in peaks)
    spans = sorted((p.start, p.end) for p in peaks)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    cov = overlap.track_coverage(f, ("chr1", 0, 100_000), groups.withColumn("reads", F.lit(10)), bins=10).collect()
    assert len(cov) == 10 and sum(r.n for r in cov) == sum((0 <= p < 100_000) for s in rows for p in (s[1], s[2] - 1))
    knee = plotdata.knee_points(spark.createDataFrame([(v,) for v in [5, 3, 3, 9, None]], "n int"), "n", 50)
    assert [(r["rank"], r.reads) for r in knee.orderBy("rank").collect()] == [(1, 9), (2, 5), (3, 3), (4, 3)]


def test_poisson_quantile_of_large_means():
    from statistics import NormalDist

    from strandloom.functions.tails import poisson_cdf_value, poisson_quantile_value

    for mean in (701.0, 1000.0, 5000.0):
        for p in (0.01, 0.5, 0.999):
            k = poisson_quantile_value(p, mean)
            assert poisson_cdf_value(k - 1, mean) < p <= poisson_cdf_value(k, mean)
    mean = 1e6
    assert abs(poisson_quantile_value(0.999, mean) - NormalDist(mean, mean**0.5).inv_cdf(0.999)) < 3


def test_free_lanes(spark):
    from strandloom.operators.plotdata import free_lanes

    rows = [(1, "c", 0, 3), (2, "c", 1, 10), (3, "c", 4, 8), (4, "c", 5, 6), (5, "c", 10, 12), (6, "d", 2, 4), (7, "d", 2, 4)]
    df = spark.createDataFrame(rows, "id long, chr string, start int, end int").repartition(3)
    assert dict(free_lanes(df, "id").collect()) == {1: 1, 2: 2, 3: 1, 4: 3, 5: 1, 6: 1, 7: 2}


def _dense(m, nrow, ncol):
    out = np.zeros((nrow, ncol))
    for r in m.densify().collect():
        out[r.row, r.col] = r.val
    return out


def test_assign_and_mask_with_all_dense_terms(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((5, 4)) < 0.5, rng.integers(1, 9, (5, 4)), 0).astype(float)
    y = np.where(rng.random((2, 2)) < 0.5, 3.0, 0)
    mask = np.where(rng.random((5, 4)) < 0.4, 1.0, 0)
    m, v, k = (SparseMatrix.of(spark.createDataFrame([(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(a >= 0)], "row long, col long, val double"), *a.shape) for a in (x, y, mask))
    rows, cols = spark.createDataFrame([(1, 2.0), (3, -1.0)], "idx long, v double"), spark.createDataFrame([(0, 5.0), (2, 1.0)], "idx long, v double")
    moved, dense_moved = m.add_by("row", rows).add_by("col", cols).add(0.5), x + np.array([[0], [2], [0], [-1], [0]]) + np.array([[5, 0, 1, 0]]) + 0.5
    for a, da in ((m, x), (moved, dense_moved)):
        for b, db in ((v, y), (v.add(4), y + 4)):
            want = da.copy()
            want[np.ix_([1, 4], [0, 3])] = db
            assert np.allclose(_dense(a.assign([1, 4], [0, 3], b), 5, 4), want)
        assert np.allclose(_dense(a.mask(k), 5, 4), np.where(mask != 0, 0, da))
        assert np.allclose(_dense(a.mask(k, invert=True), 5, 4), np.where(mask != 0, da, 0))
    with pytest.raises(Exception, match="positive"):
        m.min_by("row", rows).entries.collect()
    with pytest.raises(ValueError):
        1 / m


def test_iterated_factorisation_and_regression(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((80, 40)) < 0.3, rng.poisson(3, (80, 40)), 0).astype(float)
    m = SparseMatrix.of(spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in np.argwhere(x)], "row long, col long, val double"), 80, 40)
    u, d, v = np.linalg.svd(x, full_matrices=False)
    for side in (linalg.GRAM_SIDE, 0):
        left, values, right = linalg.svds(m, 4, side)
        assert np.allclose(values, d[:4], rtol=1e-8)
        lu, rv = (np.array([r.vector for r in t.orderBy("idx").collect()]) for t in (left, right))
        assert np.allclose(lu * values @ rv.T, u[:, :4] * d[:4] @ v[:4], atol=1e-5)
    design = rng.normal(size=(40, 2))
    got = linalg.regress_out(m, spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(design)], "idx long, a double, b double"))
    full = np.column_stack([np.ones(40), design])
    want = x - x @ full @ np.linalg.inv(full.T @ full) @ full.T
    for r in got.collect():
        assert abs(r.val - want[r.row, r.col]) < 1e-8


def test_restarted_factorisation(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((160, 90)) < 0.3, rng.poisson(3, (160, 90)), 0).astype(float)
    m = SparseMatrix.of(spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in np.argwhere(x)], "row long, col long, val double"), 160, 90)
    monkeypatch.setattr(linalg, "BASIS", 90 * 40)
    left, values, right = linalg.svds(m, 2, 0)
    u, d, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, d[:2], rtol=1e-7)


def test_regression_in_blocks_shuffles_no_dense_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.where(rng.random((30, 50)) < 0.2, rng.poisson(3, (30, 50)), 0).astype(float)
    x[4] = 0
    m = SparseMatrix.of(spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in np.argwhere(x)], "row long, col long, val double"), 30, 50)
    design = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(design)], "idx long, a double, b double")
    full = np.column_stack([np.ones(50), design])
    want = x - x @ full @ np.linalg.inv(full.T @ full) @ full.T
    for bound in (linalg.DESIGN, 30):
        monkeypatch.setattr(linalg, "DESIGN", bound)
        out = linalg.regress_out(m, df)
        assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
        got = {(r.row, r.col): r.val for r in out.collect()}
        assert got.keys() == {(r, c) for r in range(30) if x[r].any() for c in range(50)}
        assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())
    monkeypatch.undo()
    plain = linalg.regress_out(m, df.select("idx"))
    assert all(r.val == pytest.approx(x[r.row, r.col] - x[r.row].mean()) for r in plain.collect())


def test_lists_find_nearly_all_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(15, 8)) * 3
    x = centres[rng.integers(0, 15, 1500)] + rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in graph.approximate_neighbours(df, 10, lists=30, probes=6).collect():
        got.setdefault(r.i, []).append(r.idx)
    hits = sum(len(set(np.argsort(((x - x[k]) ** 2).sum(axis=1))[:10]) & set(got[k])) for k in range(0, 1500, 10))
    assert len(got) == 1500 and all(v[0] == k for k, v in got.items()) and hits > 0.9 * 1500
    assert graph.approximate_neighbours(df.limit(0)).count() == 0


def test_selection_by_index_and_argument_checks(spark):
    assert fragments.picked(["a", "b", "c"], [True, False, True]) == ["a", "c"] and fragments.picked(["a", "b", "c"], [-1, 0]) == ["c", "a"]
    for wrong in ([0, -3], [3], [True]):
        with pytest.raises(ValueError):
            fragments.picked(["a", "b", "c"], wrong)
    df = spark.createDataFrame([("chr1", 1, 2)], "chr string, start int, end int")
    assert ranges.require_ranges(df) is df
    with pytest.raises(ValueError, match="strand"):
        ranges.require_ranges(df, "strand")
    with pytest.raises(TypeError):
        ranges.require_ranges(df.withColumn("end", F.lit("x")))
    mean = 1e6
    assert abs(poisson_quantile_value(0.99, mean) - (mean + 2.3263 * 1000)) < 5 and poisson_quantile_value(0.99, 746.0) == 810
