"""Clusters of mutually similar nodes of a weighted graph, by hierarchical density clustering.

1. Usable edges are made undirected and unique, in blocks of bounded size.
2. Similarity of the ends of an edge: the cosine of what walks from both reach (``walks``), whatever
   the weight of a single edge.
3. Mutual reachability: an edge is as similar as its ends are, but not more than either end is to
   its ``core``-th most similar neighbour.
4. Borůvka rounds take the edges of the maximum spanning forest, finest level first; levels are
   -log(1 - similarity) in steps of STEP (``contract``).
5. The components of each level make up the hierarchy, condensed by ``min_size``; the most stable
   branches are the clusters.  A member's persistence is the finest level at which it is in a
   component of ``min_size``; the most persistent members are the exemplars.

All steps are supersteps over blocks of at most about ``block_rows`` links (``blocks``).  The number
of blocks follows the rows; a graph of one block takes the same steps within one task.

Defined cases: edges with a null end, i = j, or a weight that is null, NaN or outside (0, 1] are
unusable; repeated and turned-round edges count once (the largest weight); a node without usable
edges, or in no cluster of ``min_size``, gets no row; ties go to the smaller ids; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import Blocks, LocalBlock
from .contract import begin, levels, nothing, select
from .walks import build, similarities, spread

STEP = 0.4
#: Links or edges that a block holds at most, about (a node with more than a quarter is spread).
BLOCK_ROWS = 400_000


def usable_edges(df: DataFrame, i: str = "i", j: str = "j", weight: str = "weight") -> DataFrame:
    """``i, j, w``: the usable rows."""
    rows = df.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), F.col(weight).cast("double").alias("w"))
    return rows.where("i is not null and j is not null and i <> j and w > 0 and w <= 1 and not isnan(w)")


def _program(blocks: Blocks | LocalBlock, any_heavy: bool, core: int, min_size: int, steps: int | None, block_rows: int, keep_forest: bool) -> None:
    edges, _ = similarities(blocks, core, STEP, any_heavy, steps)
    if not edges:
        blocks.step(nothing)
        return
    level = max(s[0] for s in blocks.step(begin, keep_forest))
    levels(blocks, level, min_size, block_rows)
    if isinstance(blocks, Blocks) and blocks.count == 1:
        blocks.within(select)
    else:
        select(blocks)


def _clustered(df: DataFrame, i: str, j: str, weight: str, min_size: int, steps: int | None, core: int, block_rows: int, keep_forest: bool = False) -> Blocks | None:
    rows = usable_edges(df, i, j, weight)
    ends = rows.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    links, most = ends.agg(F.sum("n"), F.max("n")).first()
    if not links:
        return None
    heavy = np.empty(0, np.int64)
    if most > block_rows // 4:  # at most 4 of them for each block's worth of links
        heavy = np.sort(np.array([r[0] for r in ends.where(F.col("n") > block_rows // 4).collect()], np.int64))
    count = 1
    while links > count * block_rows:
        count *= 2
    blocks = Blocks.load(rows.mapInArrow(spread(count, heavy), "block int, data binary"), count, build(heavy))
    args = (len(heavy) > 0, core, min_size, steps, block_rows, keep_forest)
    if count == 1:
        blocks.within(_program, *args)
    else:
        _program(blocks, *args)
    return blocks


def density_clusters(df: DataFrame, i: str = "i", j: str = "j", weight: str = "weight", min_size: int = 5, steps: int | None = None, core: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, cluster_id, persistence``: each node in a cluster; the cluster is named by its
    smallest id.  The steps of the walks follow the number of nodes and end by what is measured
    (``walks.similarities``); a number in ``steps`` fixes them instead."""
    schema = "id bigint, cluster_id bigint, persistence int"
    blocks = _clustered(df, i, j, weight, min_size, steps, core, block_rows)
    if blocks is None:
        return df.sparkSession.createDataFrame([], schema)
    return blocks.frame(lambda st: {"id": st["id"], "cluster_id": st["cluster"], "persistence": st["level"]}, schema)


def spanning_forest(df: DataFrame, i: str = "i", j: str = "j", weight: str = "weight", steps: int | None = None, core: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, s``: the edges of the maximum spanning forest by mutual reachability."""
    schema = "a bigint, b bigint, s double"
    blocks = _clustered(df, i, j, weight, 2, steps, core, block_rows, True)
    if blocks is None:
        return df.sparkSession.createDataFrame([], schema)
    return blocks.frame(lambda st: st["forest"] | {"s": st["forest"]["s"].astype(float)}, schema)


def describe_clusters(nodes: DataFrame, exemplars: int = 3) -> DataFrame:
    """``cluster_id, n_members, exemplars``: the members that persist to the finest levels, ties to
    the smaller id."""
    best = nodes.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("persistence"), "id"))).where(F.col("r") <= exemplars)
    top = best.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("x"))
    size = nodes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return size.join(top, "cluster_id").select("cluster_id", "n_members", F.col("x.id").alias("exemplars"))
