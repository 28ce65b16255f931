"""The tables behind plots: no drawing, only what would be drawn."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matrix import SparseMatrix
from .ranges import checked_broadcast


def dot_table(m: SparseMatrix, features: list[int], groups: DataFrame) -> DataFrame:
    """``row, cell_group, mean_z, percent``: the group mean of each feature's z-score over all
    columns, and the share of non-zero values; zeros count by closed forms."""
    n = m.ncol
    e = m.entries.where(F.col("row").isin(features))
    s = e.groupBy("row").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("ss"))
    s = s.select("row", (F.col("s") / n).alias("mean"), F.sqrt((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)).alias("sd"))
    g = groups.select(F.col("idx").alias("col"), "cell_group")
    size = g.groupBy("cell_group").agg(F.count(F.lit(1)).alias("n"))
    by = e.join(checked_broadcast(g), "col").groupBy("row", "cell_group").agg(F.sum("val").alias("gs"), F.count(F.lit(1)).alias("k"))
    full = s.crossJoin(checked_broadcast(size)).join(by, ["row", "cell_group"], "left")
    mean = F.coalesce("gs", F.lit(0.0)) / F.col("n")
    return full.select("row", "cell_group", ((mean - F.col("mean")) / F.col("sd")).alias("mean_z"), (100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).alias("percent"))


def feature_table(m: SparseMatrix, features: list[int]) -> DataFrame:
    """One row per column with a value for each feature, zeros filled in: ``col, f<row>...``."""
    e = m.entries.where(F.col("row").isin(features))
    wide = e.groupBy("col").agg(*[F.sum(F.when(F.col("row") == f, F.col("val"))).alias(f"f{f}") for f in features])
    return m.cols().join(wide, "col", "left").fillna(0.0)


def knee_points(counts: DataFrame, value: str, points: int = 1000, cutoff: float | None = None) -> DataFrame:
    """``rank, reads`` at up to ``points`` ranks of equal steps in the logarithm, most reads first.

    Ranks come from value frequencies in two steps, blocks of adjacent values and values in a
    block, so no task sorts all rows or all values."""
    freq = counts.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("reads")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("reads") / 1024))
    blocks = freq.groupBy("b").agg(F.sum("n").alias("m"))
    start = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    placed = freq.join(blocks.select("b", F.coalesce(F.sum("m").over(start), F.lit(0)).alias("before")), "b")
    inside = Window.partitionBy("b").orderBy(F.desc("reads")).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.select("reads", (F.col("before") + F.sum("n").over(inside)).alias("last"), "n")
    total = freq.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    step = F.log(F.greatest(F.col("t"), F.lit(1)).cast("double")) / (points - 1)
    ranks = total.where("t > 0").select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.round(F.exp(k * step)).cast("bigint")))).alias("rank"))
    out = upto.join(F.broadcast(ranks), (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n"))).select("rank", "reads")  # at most ``points`` ranks
    return out if cutoff is None else out.withColumn("over_cutoff", F.col("reads") >= cutoff)


def tss_scatter(qc: DataFrame, min_frags: float, min_tss: float, bins: int = 100) -> DataFrame:
    """``x_bin, y_bin, n, n_pass``: cells by bins of log10 fragments and of TSS enrichment."""
    x = F.floor(F.log10("n_fragments") * (bins / 6)).cast("int")
    y = F.floor(F.col("tss_enrichment") * (bins / 50)).cast("int")
    keep = (F.col("n_fragments") >= min_frags) & (F.col("tss_enrichment") >= min_tss)
    return qc.where("n_fragments > 0").groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("n_pass"))


def clipped_segments(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of ``chr, start, end`` that overlap a region, cut at its ends."""
    hit = df.where((F.col("chr") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    return hit.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})


def lanes(df: DataFrame, key: str) -> DataFrame:
    """``key, lanes``: for each row of a (small, cut) region how many rows that begin no later are
    still open at its start.  That is a depth; ``free_lanes`` assigns lanes without overlaps."""
    points = df.select(key, F.col("start").alias("p"), F.lit(1).alias("d")).unionByName(df.select(key, F.col("end").alias("p"), F.lit(-1).alias("d")))
    w = Window.partitionBy("chr").orderBy("p", "d", key).rowsBetween(Window.unboundedPreceding, 0)
    points = points.join(df.select(key, "chr"), key)
    return points.withColumn("lanes", F.sum("d").over(w)).where("d = 1").select(key, F.col("lanes").cast("int").alias("lanes"))


def _lowest_free(group: pa.Table) -> pa.Table:
    open_, free, lane, n = [], [], [], 0
    for start, end in zip(group["start"].to_pylist(), group["end"].to_pylist()):
        while open_ and open_[0][0] <= start:
            heapq.heappush(free, heapq.heappop(open_)[1])
        if not free:
            n += 1
            heapq.heappush(free, n)
        lane.append(heapq.heappop(free))
        heapq.heappush(open_, (end, lane[-1]))
    return pa.table({"key": group["key"], "lane": pa.array(lane, pa.int32())})


def free_lanes(df: DataFrame, key: str) -> DataFrame:
    """``key, lane``: the lowest lane (from 1) that no range placed before, by start, end and
    ``key``, still holds; per chromosome, each connected group of overlapping ranges in one task."""
    rows = df.select(F.col(key).alias("key"), "chr", "start", "end")
    before = Window.partitionBy("chr").orderBy("start", "end", "key").rowsBetween(Window.unboundedPreceding, -1)
    fresh = rows.withColumn("new", (F.col("start") >= F.max("end").over(before)).cast("int"))
    upto = Window.partitionBy("chr").orderBy("start", "end", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = fresh.withColumn("part", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    ordered = lambda t: _lowest_free(t.sort_by([("start", "ascending"), ("end", "ascending"), ("key", "ascending")]))
    kind = rows.schema["key"].dataType.simpleString()
    return placed.groupBy("chr", "part").applyInArrow(ordered, f"key {kind}, lane int").withColumnRenamed("key", key)


def arrow_segments(df: DataFrame, key: str, spacing: int) -> DataFrame:
    """``key, from_pos, to_pos``: pieces of each range at multiples of ``spacing`` from its start,
    turned round on minus strands."""
    marks = F.filter(F.concat(F.sequence(F.col("start"), F.col("end"), F.lit(spacing)), F.array("end")), lambda x, i: F.lit(True))
    s = df.select(key, "strand", F.explode(F.array_distinct(marks)).alias("at"))
    after = F.lead("at").over(Window.partitionBy(key).orderBy("at"))
    s = s.withColumn("next", after).where("next is not null")
    return s.select(key, F.when(F.col("strand"), F.col("at")).otherwise(F.col("next")).alias("from_pos"), F.when(F.col("strand"), F.col("next")).otherwise(F.col("at")).alias("to_pos"))


def loop_arcs(loops: DataFrame, key: str, chrom: str, start: int, end: int, points: int = 101, curvature: float = 0.75) -> DataFrame:
    """``key, step, x, y``: an arc for each loop that overlaps a region without spanning it."""
    hit = loops.where((F.col("chr") == chrom) & (F.col("start") < end) & (F.col("end") > start) & ~((F.col("start") <= start) & (F.col("end") >= end)))
    half = curvature * 3.141592653589793 / 2
    low = F.cos(F.lit(half))
    angle = (F.col("step") / (points - 1) * 2 - 1) * half
    width = F.col("end") - F.col("start")
    arc = hit.select(key, "start", "end", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    return arc.select(key, "step", ((F.col("start") + F.col("end")) / 2 + width / 2 * F.sin(angle) / F.sin(F.lit(half))).alias("x"), (-(F.cos(angle) - low) / (1 - low) * width).alias("y"))


def exon_table(exons: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Exons with their transcript's ``gene_name`` and ``strand``; an exon of no transcript, or of
    several, raises when the table is read."""
    t = transcripts.select("transcript_id", "gene_name", "strand").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("transcript_id")))
    out = exons.join(t, "transcript_id", "left")
    bad = F.col("__n").isNull() | (F.col("__n") > 1)
    return out.withColumn("gene_name", F.when(bad, F.raise_error(F.lit("an exon has no single transcript"))).otherwise(F.col("gene_name"))).drop("__n")


def smoothed_features(m: SparseMatrix, features: list[int], weights: SparseMatrix, rounds: int = 3, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``col, row, value`` of features averaged over the neighbours of each column (``weights``:
    columns by columns, each column's sum is made 1), the mean restored, and cut at quantiles."""
    total = weights.entries.groupBy("col").agg(F.sum("val").alias("t"))
    s = weights.entries.join(total, "col").select("row", "col", (F.col("val") / F.col("t")).alias("w")).persist()
    x = m.entries.where(F.col("row").isin(features)).select("row", "col", "val")
    mean = x.groupBy("row").agg((F.sum("val") / m.ncol).alias("before"))
    for _ in range(rounds):
        x = x.select("row", F.col("col").alias("k"), "val").join(s.select(F.col("row").alias("k"), "col", "w"), "k").groupBy("row", "col").agg(F.sum(F.col("val") * F.col("w")).alias("val"))
    after = x.groupBy("row").agg((F.sum("val") / m.ncol).alias("after"))
    scaled = x.join(mean, "row").join(after, "row").select("row", "col", (F.col("val") * F.col("before") / F.col("after")).alias("val"))
    full = m.cols().crossJoin(F.broadcast(m.entries.sparkSession.createDataFrame([(f,) for f in features], "row bigint"))).join(scaled, ["row", "col"], "left").withColumn("val", F.coalesce("val", F.lit(0.0)))
    q = full.groupBy("row").agg(F.percentile("val", F.array(F.lit(low), F.lit(high))).alias("q"))
    return full.join(F.broadcast(q), "row").select("col", "row", F.least(F.greatest("val", F.col("q")[0]), F.col("q")[1]).alias("value"))
