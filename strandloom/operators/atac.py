"""Quality measures, peak calling and gene scores of chromatin accessibility data.

Compositions of the overlap, matrix and window operators; genes have ``chr, start, end, strand``
(true is plus).  Cells or genes without any cut site have no row unless stated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import benjamini_hochberg, poisson_cdf, poisson_quantile
from ..session import cut_lineage
from .fragments import insertions, merge_cells, nucleosome_counts
from .overlap import tile_matrix
from .ranges import checked_broadcast, distance_to_nearest, extend_ranges, merge_ranked, points_in_ranges, range_join

# Windows around transcription starts, in bases.
TSS_BEFORE, TSS_WIDTH = 50, 101
FLANK_AFTER, FLANK_BEFORE, FLANK_WIDTH = 1901, 2000, 100
PROMOTER_BEFORE, PROMOTER_WIDTH = 2000, 2101


def _windows(df: DataFrame, start, width: int, origin: str) -> DataFrame:
    at = F.greatest(start, F.lit(0))
    return df.select("chr", at.cast("int").alias("start"), (at + width).cast("int").alias("end"), F.lit(origin).alias("origin"))


def qc_windows(genes: DataFrame, blacklist: DataFrame) -> DataFrame:
    """``chr, start, end, origin``: windows at transcription starts, their flanks, promoters and
    the blacklist, in one table so that fragments are joined once."""
    tss = genes.select("chr", F.when(F.col("strand"), F.col("start")).otherwise(F.col("end") - 1).alias("tss")).distinct()
    p = F.col("tss")
    parts = [
        _windows(tss, p - TSS_BEFORE, TSS_WIDTH, "tss"),
        _windows(tss, p + FLANK_AFTER, FLANK_WIDTH, "flank"),
        _windows(tss, p - FLANK_BEFORE, FLANK_WIDTH, "flank"),
        _windows(genes, F.when(F.col("strand"), F.col("start") - PROMOTER_BEFORE).otherwise(F.col("end") - TSS_WIDTH), PROMOTER_WIDTH, "promoter"),
        blacklist.select("chr", "start", "end", F.lit("blacklist").alias("origin")),
    ]
    return reduce(DataFrame.unionByName, parts)


def qc_cells(frags: DataFrame, genes: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Per cell: fragments, nucleosome classes, cut sites in the windows and TSS enrichment."""
    sites = insertions(frags.select("chr", "start", "end", "cell_id")).select("chr", "pos", "cell_id")
    hits = points_in_ranges(sites, "pos", qc_windows(genes, blacklist))
    n = lambda o: F.count_if(F.col("r_origin") == o)
    sums = hits.groupBy("cell_id").agg(n("tss").alias("reads_in_tss"), n("flank").alias("reads_flanking_tss"), n("promoter").alias("reads_in_promoter"), n("blacklist").alias("reads_in_blacklist"))
    names = ("reads_in_tss", "reads_flanking_tss", "reads_in_promoter", "reads_in_blacklist")
    out = nucleosome_counts(frags).join(sums, "cell_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return out.withColumn("tss_enrichment", F.col("reads_in_tss") / TSS_WIDTH / F.greatest(F.col("reads_flanking_tss") / (2 * FLANK_WIDTH), F.lit(0.1)))


def call_peaks(frags: DataFrame, chrom_sizes: DataFrame, groups: DataFrame, genome_size: float | None = None, peak_width: int = 200, peak_tiling: int = 3, fdr: float = 0.01, merge: str = "none") -> DataFrame:
    """``cell_group, chr, start, end, n, p_val, q_val, enrichment`` of tiles with more cut sites
    than a Poisson background explains.  ``merge``: greedily drop overlapping peaks of lesser
    enrichment within a ``group``, or over ``all`` by the rank in the group; or ``none``."""
    pooled = merge_cells(frags, groups).withColumnRenamed("cell_id", "cell_group")
    sizes = checked_broadcast(chrom_sizes.select("chr", F.col("chr_size").cast("int").alias("chr_size")))
    sites = insertions(pooled.select("chr", "start", "end", F.col("cell_group"))).select("chr", "pos", "cell_group").join(sizes, "chr").where("pos >= 0 and pos < chr_size")
    if genome_size is None:
        genome_size = float(chrom_sizes.agg(F.sum("chr_size")).first()[0] or 0)
    # cut sites are counted once, in the pieces between the starts of any offset's tiles
    offsets = [peak_width * k // peak_tiling for k in range(1, peak_tiling + 1)]
    within = F.pmod(F.col("pos"), F.lit(peak_width))
    piece = (F.col("pos") - within + reduce(lambda x, o: F.greatest(x, F.when(within >= o, o).otherwise(0)), offsets[:-1], F.lit(0))).cast("int")
    pieces = cut_lineage(sites.groupBy("cell_group", "chr", piece.alias("piece"), "chr_size").agg(F.count(F.lit(1)).alias("n")))
    background = pieces.groupBy("cell_group").agg((F.sum("n") / F.lit(genome_size) * peak_width).alias("bg"))
    background = background.withColumn("least", poisson_quantile(F.lit(1 - fdr), F.col("bg")))
    tiles_of = lambda o: F.sum(F.when(F.col("chr_size") > o, F.ceil((F.col("chr_size") - o) / peak_width)).otherwise(0))
    totals = chrom_sizes.agg(*[tiles_of(o).alias(f"t{o}") for o in offsets]).select(F.inline(F.array(*[F.struct(F.lit(o).alias("offset"), F.col(f"t{o}").alias("tiles")) for o in offsets])))  # a row an offset
    begins = F.array(*[F.struct(F.lit(o).alias("offset"), (F.floor((F.col("piece") - o) / peak_width) * peak_width + o).cast("int").alias("start")) for o in offsets])
    tiles = pieces.select("cell_group", "chr", "chr_size", "n", F.inline(begins)).where("start >= offset").groupBy("offset", "cell_group", "chr", "start", "chr_size").agg(F.sum("n").alias("n"))
    rich = tiles.join(checked_broadcast(background), "cell_group").where("n > least").join(F.broadcast(totals), "offset")
    rich = rich.withColumn("p_val", poisson_cdf(F.col("bg"), F.col("n").cast("double")))
    tested = benjamini_hochberg(rich, ["offset", "cell_group"], "p_val", "tiles", "q_val").where(F.col("q_val") < fdr)
    peaks = tested.select("cell_group", "chr", "start", F.least(F.col("start") + peak_width, "chr_size").alias("end"), "n", "p_val", "q_val", (F.col("n") / F.col("bg")).alias("enrichment"))
    if merge == "none":
        return peaks
    place = Window.partitionBy("cell_group").orderBy(F.desc("enrichment"), "chr", "start")
    ranked = peaks.withColumn("__r", F.row_number().over(place))
    # one order over all peaks: by rank in the group, then group
    key = F.concat_ws(":", F.lpad(F.col("__r").cast("string"), 12, "0"), "cell_group")
    if merge == "all":
        return merge_ranked(ranked.withColumn("__k", key), "__k").drop("__r", "__k")
    own = ranked.withColumn("__k", key).withColumn("__chr", F.col("chr")).withColumn("chr", F.concat_ws("\t", "cell_group", "chr"))
    return merge_ranked(own, "__k").withColumn("chr", F.col("__chr")).drop("__r", "__k", "__chr")


def gene_tiles(genes: DataFrame, chrom_sizes: DataFrame, tile_width: int = 500) -> DataFrame:
    """``gene_id, tile, chr, distance``: tiles in reach of each gene, 5 kb upstream included and
    extended by 1 to 100 kb up to the next gene, with the signed distance to the gene."""
    wide = extend_ranges(genes.select("gene_id", "chr", "start", "end", "strand"), upstream=5000, chrom_sizes=chrom_sizes)
    gaps = distance_to_nearest(wide, "gene_id")
    reach = lambda c: F.least(F.greatest(F.col(c) - tile_width, F.lit(1000.0)), F.lit(100000.0)).cast("int")
    sized = wide.join(gaps.select("gene_id", reach("upstream").alias("up"), reach("downstream").alias("down")), "gene_id").join(checked_broadcast(chrom_sizes.select("chr", "chr_size")), "chr", "left")
    low = F.greatest(F.lit(0), F.col("start") - F.when(F.col("strand"), F.col("up")).otherwise(F.col("down")))
    high = F.least(F.col("end") + F.when(F.col("strand"), F.col("down")).otherwise(F.col("up")), F.coalesce("chr_size", F.lit(2147483647)))
    sized = sized.where(low < high)  # a gene beyond the end of its chromosome has no tiles
    tiles = sized.select("gene_id", "chr", "start", "end", "strand", F.explode(F.sequence(F.floor(low / tile_width).cast("int"), F.floor((high - 1) / tile_width).cast("int"))).alias("tile"))
    at = F.col("tile") * tile_width
    distance = F.when(at >= F.col("end"), at + 1 - F.col("end")).otherwise(F.least(F.lit(0), at + tile_width - 1 - F.col("start")))
    return tiles.select("gene_id", "chr", "tile", (distance * F.when(F.col("strand"), 1).otherwise(-1)).alias("distance"))


def gene_weights(genes: DataFrame, chrom_sizes: DataFrame, blacklist: DataFrame | None = None, tile_width: int = 500) -> DataFrame:
    """``gene_id, chr, tile, weight``: falling with the distance, and up to five times as large for
    the shortest genes."""
    t = gene_tiles(genes, chrom_sizes, tile_width)
    t = t.withColumn("distance", F.col("distance") - F.signum(F.col("distance").cast("double")))
    if blacklist is not None:
        spans = t.select("chr", "tile").distinct().select("chr", "tile", (F.col("tile") * tile_width).alias("start"), ((F.col("tile") + 1) * tile_width).alias("end"))
        bad = range_join(spans, blacklist.select("chr", "start", "end")).select("chr", "tile").distinct()
        t = t.join(bad, ["chr", "tile"], "left_anti")
    inverse = genes.select("gene_id", (1.0 / (F.col("end") - F.col("start") + 5000)).alias("inv"))
    ends = inverse.agg(F.max("inv").alias("hi"), F.min("inv").alias("lo"))  # one row
    by_width = inverse.crossJoin(F.broadcast(ends)).select("gene_id", F.when(F.col("hi") > F.col("lo"), 1 + F.col("inv") * 4 / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("by_width"))
    near = F.exp(-F.abs("distance") / 5000.0) + F.exp(F.lit(-1.0))
    return t.join(checked_broadcast(by_width), "gene_id").select("gene_id", "chr", "tile", (near * F.col("by_width")).alias("weight"))


def gene_scores(frags: DataFrame, genes: DataFrame, chrom_sizes: DataFrame, blacklist: DataFrame | None = None, tile_width: int = 500, max_count: int = 4, scale: float = 10_000.0) -> DataFrame:
    """``gene_id, cell_id, score``: weighted cut sites near genes, at most ``max_count`` a tile,
    scaled to ``scale`` per cell."""
    regions = chrom_sizes.select(F.col("chr").alias("region_id"), "chr", F.lit(0).alias("start"), F.col("chr_size").cast("int").alias("end"), F.lit(tile_width).alias("tile_width"))
    tiles = tile_matrix(frags, regions).select(F.col("region_id").alias("chr"), F.col("tile_no").alias("tile"), "cell_id", F.least("n", F.lit(max_count)).alias("n"))
    score = tiles.join(gene_weights(genes, chrom_sizes, blacklist, tile_width), ["chr", "tile"]).groupBy("gene_id", "cell_id").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    total = score.groupBy("cell_id").agg(F.sum("score").alias("__t"))
    return score.join(total, "cell_id").select("gene_id", "cell_id", (F.col("score") * scale / F.col("__t")).alias("score"))
