"""Matrices counted from fragments and ranges, as sparse rows (range, cell, n).

Peaks have ``peak_id, chr, start, end``; regions ``region_id, chr, start, end, tile_width``.  Counts
that are zero have no row; nulls overlap nothing; repeated fragments count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fragments import insertions
from .ranges import checked_broadcast, points_in_ranges, range_join


def peak_matrix(frags: DataFrame, peaks: DataFrame, mode: str = "insertions") -> DataFrame:
    """``peak_id, cell_id, n``.  ``insertions``: cut sites in the peak; ``fragments``: fragments
    with at least one; ``overlaps``: fragments that overlap the peak, also by spanning it."""
    f = frags.select("chr", "start", "end", "cell_id")
    p = peaks.select("peak_id", "chr", "start", "end")
    if mode == "overlaps":
        hits = range_join(f, p)
    else:
        sites = insertions(f).withColumnsRenamed({"start": "f_start"}).drop("end")
        hits = points_in_ranges(sites, "pos", p)
        if mode == "fragments":  # the end counts where the start doesn't
            hits = hits.where(F.col("is_start") | ~((F.col("f_start") >= F.col("r_start")) & (F.col("f_start") < F.col("r_end"))))
    return hits.groupBy(F.col("r_peak_id").alias("peak_id"), "cell_id").agg(F.count(F.lit(1)).alias("n"))


def tile_matrix(frags: DataFrame, regions: DataFrame, mode: str = "insertions") -> DataFrame:
    """``region_id, tile_no, cell_id, n``; regions must not overlap.  In mode ``fragments`` the end
    is left out if the start lies in the same region."""
    sites = insertions(frags.select("chr", "start", "end", "cell_id")).withColumnsRenamed({"start": "f_start"}).drop("end")
    hits = points_in_ranges(sites, "pos", regions.select("region_id", "chr", "start", "end", "tile_width"))
    if mode == "fragments":
        hits = hits.where(F.col("is_start") | ~((F.col("f_start") >= F.col("r_start")) & (F.col("f_start") < F.col("r_end"))))
    tile = F.floor((F.col("pos") - F.col("r_start")) / F.col("r_tile_width")).cast("int")
    return hits.groupBy(F.col("r_region_id").alias("region_id"), tile.alias("tile_no"), "cell_id").agg(F.count(F.lit(1)).alias("n"))


def footprint(frags: DataFrame, motifs: DataFrame, cells: DataFrame, flank: int = 125, normalization_width: int | None = None) -> DataFrame:
    """``cell_group, position, n, enrichment``: weighted cut sites around motif centres
    (``chr, start, end, strand``), mirrored for minus strands.  ``cells``: ``cell_id, cell_group,
    weight``.  The enrichment is
    against the mean of the outer bases of both sides, null where that is 0."""
    width = flank // 10 if normalization_width is None else normalization_width
    centre = F.when(F.col("strand"), F.col("start")).otherwise(F.col("end") - 1)
    around = motifs.select("chr", (centre - flank).alias("start"), (centre + flank + 1).alias("end"), centre.alias("centre"), "strand")
    sites = insertions(frags.select("chr", "start", "end", "cell_id")).select("chr", "pos", "cell_id")
    hits = points_in_ranges(sites, "pos", around).join(checked_broadcast(cells), "cell_id")
    offset = F.when(F.col("r_strand"), F.col("pos") - F.col("r_centre")).otherwise(F.col("r_centre") - F.col("pos"))
    found = hits.groupBy("cell_group", offset.alias("position")).agg(F.sum("weight").alias("n"))
    grid = cells.select("cell_group").distinct().withColumn("position", F.explode(F.sequence(F.lit(-flank), F.lit(flank))))
    full = grid.join(found, ["cell_group", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    outer = F.abs("position") > flank - width
    base = F.avg(F.when(outer, F.col("n"))).over(Window.partitionBy("cell_group"))  # 2 * flank + 1 rows a group
    return full.withColumn("enrichment", F.try_divide(F.col("n"), base))


def insertion_counts(frags: DataFrame, groups: DataFrame, mode: str = "both") -> DataFrame:
    """``cell_group, chr, pos, n``: cut sites per base and group of cells."""
    sites = insertions(frags.select("chr", "start", "end", "cell_id"), mode)
    return sites.join(checked_broadcast(groups), "cell_id").groupBy("cell_group", "chr", "pos").agg(F.count(F.lit(1)).alias("n"))


def insertion_bedgraph(frags: DataFrame, groups: DataFrame, tile_width: int = 1, normalization: str = "none", mode: str = "both", chrom_sizes: DataFrame | None = None) -> DataFrame:
    """``cell_group, chr, start, end, score`` of tiles with cut sites.  ``cpm``: per million of the
    group's cut sites; ``n_cells``: per cell of the group; the last tile ends with its chromosome."""
    sites = insertions(frags.select("chr", "start", "end", "cell_id"), mode).join(checked_broadcast(groups), "cell_id")
    start = (F.floor(F.col("pos") / tile_width) * tile_width).cast("int")
    tiles = sites.groupBy("cell_group", "chr", start.alias("start")).agg(F.count(F.lit(1)).alias("score")).withColumn("end", F.col("start") + tile_width)
    if normalization == "cpm":
        total = tiles.groupBy("cell_group").agg((1e6 / F.sum("score")).alias("__f"))
    elif normalization == "n_cells":
        total = groups.groupBy("cell_group").agg((1.0 / F.count(F.lit(1))).alias("__f"))
    if normalization != "none":
        tiles = tiles.join(checked_broadcast(total), "cell_group").withColumn("score", F.col("score") * F.col("__f")).drop("__f")
    if chrom_sizes is not None:
        tiles = tiles.join(checked_broadcast(chrom_sizes.select("chr", "chr_size")), "chr").where("start < chr_size").withColumn("end", F.least("end", "chr_size"))
    return tiles.select("cell_group", "chr", "start", "end", "score")


def region_coverage(frags: DataFrame, regions: DataFrame, groups: DataFrame, bin_size: int = 1) -> DataFrame:
    """``region_id, cell_group, bin, n``: cut sites by position in regions of one width."""
    sites = insertions(frags.select("chr", "start", "end", "cell_id")).select("chr", "pos", "cell_id").join(checked_broadcast(groups), "cell_id")
    hits = points_in_ranges(sites, "pos", regions.select("region_id", "chr", "start", "end"))
    at = F.floor((F.col("pos") - F.col("r_start")) / bin_size).cast("int")
    return hits.groupBy(F.col("r_region_id").alias("region_id"), "cell_group", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def counts_in_regions(counts: DataFrame, regions: DataFrame, bin_size: int = 1) -> DataFrame:
    """``region_coverage`` from stored counts per base (``cell_group, chr, pos, n``)."""
    hits = points_in_ranges(counts, "pos", regions.select("region_id", "chr", "start", "end"))
    at = F.floor((F.col("pos") - F.col("r_start")) / bin_size).cast("int")
    return hits.groupBy(F.col("r_region_id").alias("region_id"), "cell_group", at.alias("bin")).agg(F.sum("n").alias("n"))


def tile_offsets(chrom_sizes: DataFrame, tile_width: int) -> DataFrame:
    """``chr, first_tile, n_tiles``: where each chromosome's tiles begin in one numbering of all,
    chromosomes by name.  One row a chromosome."""
    n = F.ceil(F.col("chr_size") / tile_width)
    t = chrom_sizes.select("chr", n.alias("n_tiles"))
    before = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("chr", F.coalesce(F.sum("n_tiles").over(before), F.lit(0)).alias("first_tile"), "n_tiles")


def track_coverage(frags: DataFrame, region: tuple[str, int, int], cells: DataFrame, bins: int = 500) -> DataFrame:
    """``cell_group, bin, start, end, n, normalized`` in one region; normalized by 1e9 / (reads of
    the group * bin width).  ``cells``: ``cell_id, cell_group, reads``.  All bins have a row."""
    chrom, a, b = region
    width = max(1, -(-(b - a) // bins))
    count = -(-(b - a) // width)
    sites = insertions(frags.where(F.col("chr") == chrom).select("chr", "start", "end", "cell_id")).where((F.col("pos") >= a) & (F.col("pos") < b))
    found = sites.join(checked_broadcast(cells), "cell_id").groupBy("cell_group", F.floor((F.col("pos") - a) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    reads = cells.groupBy("cell_group").agg(F.sum("reads").alias("reads"))
    full = reads.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(found, ["cell_group", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    start = F.col("bin") * width + a
    return full.select("cell_group", "bin", start.alias("start"), F.least(F.lit(b), start + width).alias("end"), "n", (F.col("n") * (1e9 / width) / F.col("reads")).alias("normalized"))
