"""The k nearest other vectors of every vector, by a forest of random-projection trees.

1. The forest is fit on a bounded sample (``sample_rows`` distinct vectors, a parameter) and
   broadcast.  Its depth follows the number of vectors as far as ``SAMPLE_ROWS_A_LEAF`` rows of the
   sample are left for each leaf.
2. Every vector goes to its own leaf of each tree, and as a query to the best leaves of the queue
   that all trees share.  Leaves that many queries reach (estimated from the sample) are given out
   in slices: all vectors of the leaf with a part of its queries each.
3. Within a leaf all its candidates are ranked by exact distances, and a last step merges the
   leaves of a query.  A leaf that is still large is split by a tree of its own vectors first, so
   the work a query costs doesn't grow with the number of vectors.

Copies of one vector are searched once: their smallest ids stand for them and are put in exactly
afterwards, so neither leaves nor results depend on how many copies there are.

Defined cases: a vector is unusable if null, of another length than ``dim``, or with a null, NaN or
infinite element, and is ignored, as are null ids; rows of one id count once (the smallest usable
vector); ties go to the smaller id; with fewer than k others all of them are given; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .forest import Forest, nearest_in_block

SAMPLE_ROWS, SAMPLE_ROWS_A_LEAF = 65_536, 32
TREES, LEAVES, LEAF_ROWS = 2, 5, 1000  # a leaf holds LEAF_ROWS to twice as many
#: Leaves of more than LARGE * LEAF_ROWS vectors are split again; a slice has about SLICE *
#: LEAF_ROWS queries; ASKED rows of the sample tell how many queries reach a leaf.
LARGE, SLICE, ASKED = 4, 16, 8192


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vec``: one row per id with a usable vector."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of fixed-size binary values (or float lists) as a matrix without copying them singly."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _router(forest, leaves: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, slices = forest.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids, asks = _matrix(batch.column(1), dim), batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 2000):
                part, ask = x[a : a + 2000], asks[a : a + 2000].astype(bool)
                to = np.full((len(part), leaves), -1, np.int64)
                if ask.any():
                    to[ask] = f.probe(part[ask], leaves)
                if not ask.all():
                    to[~ask, : f.trees] = f.probe(part[~ask], f.trees)
                row, col = np.nonzero(to >= 0)
                own, ask, leaf = col < f.trees, ask[row], to[row, col]
                # a query in one slice of the leaf, its own vectors in all of them
                times = np.where(own, slices[leaf], 1)
                at = np.repeat(np.arange(len(row)), times)
                turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                asking = ids[a : a + 2000][row] % slices[leaf]
                part_no = np.where(own[at], turn, asking[at])
                role = np.where(own[at], 1, 0) + np.where(ask[at] & (part_no == asking[at]), 2, 0)
                row = row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[at].astype(np.int32)), pa.array(part_no.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(ids[a : a + 2000][row]), _binary(part[row])],
                    names=["leaf", "slice", "role", "id", "vec"],
                )

    return run


def _nearest_in_leaf(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int, leaf_rows: int, leaves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if len(x) <= LARGE * leaf_rows or not len(q):
        return nearest_in_block(q, x, q_ids, ids, k)
    tree = Forest(x, 1, math.floor(math.log2(len(x) / leaf_rows)), seed)
    of = np.concatenate([tree.probe(x[a : a + 2000], 1)[:, 0] for a in range(0, len(x), 2000)])
    probes = min(leaves, 1 << tree.depth)
    to = np.concatenate([tree.probe(q[a : a + 2000], probes) for a in range(0, len(q), 2000)])
    near, dist = np.full((len(q), probes, k), -1, np.int64), np.full((len(q), probes, k), np.inf)
    where, held = np.argsort(to, axis=None, kind="stable"), np.argsort(of, kind="stable")
    for leaf in range(1 << tree.depth):
        here = where[slice(*np.searchsorted(to.ravel()[where], [leaf, leaf + 1]))]
        rows = held[slice(*np.searchsorted(of[held], [leaf, leaf + 1]))]
        if len(here) and len(rows):
            r, c = here // probes, here % probes
            near[r, c], dist[r, c] = nearest_in_block(q[r], x[rows], q_ids[r], ids[rows], k)
    near, dist = near.reshape(len(q), -1), dist.reshape(len(q), -1)  # one tree: no vector twice
    order = np.lexsort((near, dist), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)


def _ranker(k: int, dim: int, leaf_rows: int, leaves: int, seed: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        role, ids, x = group.column("role").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("vec"), dim)
        own, ask = role & 1 > 0, role & 2 > 0
        near, dist = _nearest_in_leaf(x[ask], x[own], ids[ask], ids[own], k, leaf_rows, leaves, seed)
        return pa.table({"id": pa.array(ids[ask]), "near": _binary(near), "dist": _binary(dist)})

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            for size in np.unique(sizes):  # nearly always one size
                pick = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(pick)
                lists = part.column(1).flatten()
                near = np.frombuffer(b"".join(lists.field("near").to_pylist()), np.int64).reshape(part.num_rows, -1)
                dist = np.frombuffer(b"".join(lists.field("dist").to_pylist()), np.float64).reshape(part.num_rows, -1).copy()
                order = np.argsort(near, axis=1, kind="stable")
                near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
                dist[:, 1:][near[:, 1:] == near[:, :-1]] = np.inf
                order = np.lexsort((near, dist), axis=1)[:, :k]
                near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
                some = ~np.isinf(dist)
                at = np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(near[some])), pa.ListArray.from_arrays(pa.array(at), pa.array(dist[some]))],
                    names=["id", "near", "dist"],
                )

    return run


def nearest_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", dim: int = 32, k: int = 10, queries: Column | None = None, trees: int = TREES, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """``i, nn_rank`` (from 1)``, idx, dist``: for each usable vector, or those for which
    ``queries`` (a condition on ``id``) holds, its nearest others by euclidean distance."""
    spark = df.sparkSession
    one = usable_vectors(df, id_col, vec_col, dim)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    # one row per distinct vector; whether any of its copies is a query
    reps = cut_lineage(one.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max(asked).alias("asks")))
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("m")).first()
    n = size["n"]
    if not n:
        return spark.createDataFrame([], "i bigint, nn_rank int, idx bigint, dist double")
    sample = reps.select("vec").sample(min(1.0, 1.1 * sample_rows / n), seed=seed).limit(sample_rows).toArrow()
    sample = _matrix(sample.column("vec"), dim) if sample.num_rows else np.zeros((0, dim), np.float32)
    depth = max(0, math.floor(math.log2(min(n / leaf_rows, max(1, sample_rows // SAMPLE_ROWS_A_LEAF)))))
    trees = trees if depth else 1  # one leaf holds all
    forest = Forest(sample, trees, depth, seed)
    probes = max(trees, min(leaves, trees << depth))
    some = forest.probe(sample[:ASKED], probes)
    reached = np.bincount(some.ravel(), minlength=trees << depth) * (n / max(1, len(some)))
    slices = np.maximum(1, np.ceil(reached / (SLICE * leaf_rows))).astype(np.int64) if depth else np.ones(trees, np.int64)
    shared = spark.sparkContext.broadcast((forest, slices))
    routed = reps.select("id", "vec", "asks").mapInArrow(_router(shared, probes, dim), "leaf int, slice int, role tinyint, id bigint, vec binary")
    ranked = routed.groupBy("leaf", "slice").applyInArrow(_ranker(k, dim, leaf_rows, leaves, seed), "id bigint, near binary, dist binary")
    lists = ranked.groupBy("id").agg(F.collect_list(F.struct("near", "dist")).alias("found"))
    found = lists.mapInArrow(_merge(k), "id bigint, near array<bigint>, dist array<double>")
    if size["m"] > n:
        found = _with_copies(one.where(asked), one, reps, found, k)
    out = found.select(F.col("id").alias("i"), F.posexplode(F.arrays_zip("near", "dist")).alias("p", "x"))
    return out.select("i", (F.col("p") + 1).alias("nn_rank"), F.col("x.near").alias("idx"), F.col("x.dist").alias("dist"))


def _with_copies(asking: DataFrame, one: DataFrame, reps: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Put the copies of vectors into the neighbours of their representatives."""
    several = reps.where("copies > 1").select("vec", F.col("id").alias("rep"))
    members = one.join(several, "vec").select("rep", "id")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    few = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k + 1
    pairs = found.select("id", F.inline(F.arrays_zip("near", "dist"))).unionByName(several.select(F.col("rep").alias("id"), F.col("rep").alias("near"), F.lit(0.0).alias("dist")))
    wide = pairs.join(few, pairs["near"] == few["rep"], "left")
    wide = wide.select("id", "dist", F.explode(F.coalesce("ids", F.array("near"))).alias("near"))
    best = wide.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("dist", "near"))).where(F.col("r") <= k + 1)
    best = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "near"))).alias("all"))
    single = reps.where("copies = 1 and asks").select("id", F.col("id").alias("rep"))
    asks = single.unionByName(asking.join(several, "vec").select("id", "rep"))
    own = asks.join(best.withColumnRenamed("id", "rep"), "rep").select("id", F.slice(F.filter("all", lambda x: x["near"] != F.col("id")), 1, k).alias("x"))
    return own.select("id", F.col("x.near").alias("near"), F.col("x.dist").alias("dist"))


def neighbour_pairs(knn: DataFrame) -> DataFrame:
    """``vec_a < vec_b``: pairs of which at least one is among the nearest of the other."""
    return knn.select(F.least("i", "idx").alias("vec_a"), F.greatest("i", "idx").alias("vec_b")).distinct()
