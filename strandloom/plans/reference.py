"""Queries of the engine's own operators on the adapted test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import atac, fragments, graph, linalg, matrix, overlap, plotdata, ranges, stats
from ..session import table
from ..sources.files import gtf_features, transcripts, whole_chromosomes
from ..sources.raw_records import load_records, valid_records
from ..streaming import tiles as stream_tiles
from . import adapters as a
from . import records
from .adapters import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- fragments ------------------------------------------------------------------------------------


@query(f'{views("frags")} SELECT frag_id, chr, start + 4 AS start, "end" - 5 AS "end", cell_id FROM frags')
def f1_shift(spark, d):
    return fragments.shift(a.frags(spark, d), 4, -5)


@query(f'{views("frags")} SELECT * FROM frags WHERE "end" - start BETWEEN 50 AND 300')
def f2_subset_lengths(spark, d):
    return fragments.subset_lengths(a.frags(spark, d), 50, 300)


@query(f"{views('frags')} SELECT *, (list_position(['chr2', 'chrX', 'chr1'], chr) - 1)::INT AS chr_id FROM frags WHERE chr IN ('chr2', 'chrX', 'chr1')")
def f3_select_chromosomes(spark, d):
    return fragments.select_chromosomes(a.frags(spark, d), ["chr2", "chrX", "chr1"])


@query(f"{views('frags', 'cg')} SELECT * FROM frags WHERE cell_id IN (SELECT cell_id FROM cg WHERE cell_group <> 'none')")
def f4_select_cells(spark, d):
    return fragments.select_cells(a.frags(spark, d), a.cell_groups(spark, d).where("cell_group <> 'none'"))


@query(f'{views("frags", "cg")} SELECT frag_id, chr, start, "end", cell_group AS cell_id FROM frags JOIN cg USING (cell_id)')
def f5_merge_cells(spark, d):
    return fragments.merge_cells(a.frags(spark, d), a.cell_groups(spark, d))


@query(f"{views('frags')} SELECT frag_id, chr, start, \"end\", 'run1.' || cell_id AS cell_id FROM frags")
def f6_prefix_cells(spark, d):
    return fragments.prefix_cells(a.frags(spark, d), "run1.")


@query(f"{views('frags')} SELECT frag_id, CASE chr WHEN 'chr1' THEN '1' WHEN 'chrX' THEN 'X' ELSE chr END AS chr, start, \"end\", cell_id FROM frags")
def f7_rename_chromosomes(spark, d):
    return fragments.rename(a.frags(spark, d), "chr", spark.createDataFrame([("chr1", "1"), ("chrX", "X")], "old string, new string"))


@query(f"{views('frags')} SELECT DISTINCT cell_id FROM frags")
def f8_cell_names(spark, d):
    return a.frags(spark, d).select("cell_id").distinct()


_HIT = 'EXISTS (SELECT 1 FROM peaks p WHERE p.chr = f.chr AND f.start < p."end" AND f."end" > p.start)'


@query(f"{views('frags', 'peaks')} SELECT f.* FROM frags f WHERE {_HIT}")
def f9_select_regions(spark, d):
    return ranges.select_overlapping(a.frags(spark, d), a.peaks(spark, d))


@query(f"{views('frags', 'peaks')} SELECT f.* FROM frags f WHERE NOT {_HIT}")
def f9_exclude_regions(spark, d):
    return ranges.select_overlapping(a.frags(spark, d), a.peaks(spark, d), invert=True)


@query(f'{views("frags")} SELECT count(*) AS n, sum(start)::BIGINT AS sum_start, sum("end")::BIGINT AS sum_end, count(DISTINCT cell_id) AS n_cells, count(DISTINCT chr) AS n_chr FROM frags')
def f11_scan(spark, d):
    return fragments.scan(a.frags(spark, d))


_PAIRS = """{v}, b AS (SELECT {other} FROM {name}), x AS ((SELECT {cols} FROM {name} EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT {cols} FROM {name}))
SELECT (SELECT count(*) FROM x) = 0 AS identical"""
_F = 'frag_id, chr, start, "end", cell_id'


@query(_PAIRS.format(v=views("frags"), name="frags", cols=_F, other='frag_id, chr, start + 3 - 3, "end", cell_id'))
def f12_identical(spark, d):
    f = a.frags(spark, d)
    return fragments.identical(f, fragments.shift(fragments.shift(f, 3, 3), -3, -3))


@query(_PAIRS.format(v=views("frags"), name="frags", cols=_F, other="frag_id, chr, start, \"end\", CASE WHEN start < 1000000 THEN 'x' ELSE cell_id END"))
def f12_unequal(spark, d):
    f = a.frags(spark, d)
    return fragments.identical(f, f.withColumn("cell_id", F.when(F.col("start") < 1_000_000, "x").otherwise(F.col("cell_id"))))


@query(f"{views('frags')} SELECT *, (list_position((SELECT [max(chr), min(chr)] FROM frags), chr) - 1)::INT AS chr_id FROM frags WHERE chr IN ((SELECT max(chr) FROM frags), (SELECT min(chr) FROM frags))")
def f3_select_chromosomes_at(spark, d):
    return fragments.select_chromosomes_at(a.frags(spark, d), [-1, 0])


@query(f"{views('frags')}, k AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS idx FROM (SELECT DISTINCT cell_id FROM frags)) SELECT frags.* FROM frags JOIN k USING (cell_id) WHERE idx BETWEEN 10 AND 99")
def f4_select_cells_at(spark, d):
    return fragments.select_cells_at(a.frags(spark, d), spark.range(10, 100).withColumnRenamed("id", "idx"))


@query(f"{views('frags', 'sites')} SELECT chr, is_start, count(*) AS n, min(pos) AS low, max(pos) AS high FROM sites GROUP BY ALL")
def f13_insertions(spark, d):
    return fragments.insertions(a.frags(spark, d)).groupBy("chr", "is_start").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))


@query(f"""{views("frags")} SELECT frag_id, chr, start, "end", CASE WHEN cell_id IN (SELECT cell_id FROM frags WHERE chr = 'chr1' INTERSECT SELECT cell_id FROM frags WHERE chr <> 'chr1')
 THEN CASE chr WHEN 'chr1' THEN '1_' ELSE '2_' END ELSE '' END || cell_id AS cell_id FROM frags""")
def u1_merge_fragments(spark, d):
    f = a.frags(spark, d)
    return fragments.merge_fragments([f.where("chr = 'chr1'"), f.where("chr <> 'chr1'")])


@query(f"{views('frags')} SELECT DISTINCT cell_id FROM frags WHERE chr = 'chr1' INTERSECT SELECT cell_id FROM frags WHERE chr <> 'chr1'")
def u5_common_cells(spark, d):
    f = a.frags(spark, d)
    return f.where("chr = 'chr1'").select("cell_id").intersect(f.where("chr <> 'chr1'").select("cell_id"))


@query(f"""{views("frags")} SELECT cell_id, count(*) FILTER (("end" - start) // 147 = 0) AS sub_nucleosomal, count(*) FILTER (("end" - start) // 147 = 1) AS mono_nucleosomal,
 count(*) FILTER (("end" - start) // 147 >= 2) AS multi_nucleosomal, count(*) AS n_fragments FROM frags GROUP BY cell_id""")
def a9_nucleosome_counts(spark, d):
    return fragments.nucleosome_counts(a.frags(spark, d))


@query(f"""{views("frags")} SELECT length, n, n / (SELECT count(*) FROM frags) AS proportion FROM (SELECT "end" - start AS length, count(*) AS n FROM frags GROUP BY 1) WHERE length <= 500""")
def a10_fragment_lengths(spark, d):
    return fragments.length_histogram(a.frags(spark, d))


# -- ranges ---------------------------------------------------------------------------------------


@query(f"{views('peaks')} SELECT peak_id, chr, start, \"end\" FROM peaks")
def g1_normalize_ranges(spark, d):
    p = a.peaks(spark, d)
    number = lambda c: F.format_number(c, 0)
    return ranges.normalize_ranges(p.select("peak_id", F.concat("chr", F.lit(":"), number(F.col("start") + 1), F.lit("-"), number(F.col("end"))).alias("range"))).drop("range")


@query(f"""{views("genes", "sizes")} SELECT gene_id, gene_name, g.chr, greatest(0, start - CASE WHEN strand THEN 5000 ELSE 1000 END)::INT AS start,
 least("end" + CASE WHEN strand THEN 1000 ELSE 5000 END, coalesce(chr_size, 2147483647))::INT AS "end", strand FROM genes g LEFT JOIN sizes USING (chr)""")
def g2_extend_ranges(spark, d):
    return ranges.extend_ranges(a.genes(spark, d), 5000, 1000, a.chrom_sizes(spark, d))


def _symbols(spark, d):
    p = table(spark, d, "part")
    mapping = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("old"), F.col("p_partkey").cast("string")).alias("alias"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("canonical"))
    ask = p.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("old")).otherwise(F.col("p_name")), F.col("p_partkey").cast("string")).alias("symbol"))
    return mapping, ask


_SYMBOLS = """WITH mapping AS (SELECT 'old' || p_partkey AS alias, p_name || p_partkey AS canonical FROM part WHERE p_partkey % 3 = 0),
ask AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE p_name END || p_partkey AS symbol FROM part)"""


@query(f"{_SYMBOLS} SELECT symbol, coalesce(p_name || p_partkey, canonical) AS matched FROM ask LEFT JOIN part ON symbol = p_name || p_partkey LEFT JOIN mapping ON symbol = alias")
def g3_match_symbols(spark, d):
    mapping, ask = _symbols(spark, d)
    return ranges.match_symbols(ask, a.genes(spark, d).select(F.col("gene_name").alias("symbol")), mapping)


@query(f"{_SYMBOLS} SELECT symbol, canonical FROM ask LEFT JOIN mapping ON symbol = alias")
def g4_canonical_symbols(spark, d):
    mapping, ask = _symbols(spark, d)
    return ranges.canonical_symbols(ask, mapping)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') ELSE 'X' || p_partkey || '.2' END AS ident FROM part")
def g5_without_version(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"), F.lit(".7"))).otherwise(F.concat(F.lit("X"), F.col("p_partkey").cast("string"), F.lit(".2")))
    return table(spark, d, "part").select("p_partkey", ranges.without_version(raw).alias("ident"))


@query(f"""{views("genes")} SELECT chr, greatest(0, start - CASE WHEN strand THEN 10000 ELSE 20000 END)::INT AS start, ("end" + CASE WHEN strand THEN 20000 ELSE 10000 END)::INT AS "end", strand
 FROM genes WHERE gene_name = (SELECT min(gene_name) FROM genes)""")
def g6_gene_region(spark, d):
    g = a.genes(spark, d)
    return ranges.gene_region(g, g.agg(F.min("gene_name")).first()[0], 10_000, 20_000)


@query("""WITH f AS (SELECT c_custkey, c_name, regexp_replace('a b/' || c_mktsegment, '[^A-Za-z0-9._-]', '_', 'g') AS f FROM customer),
 r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY lpad(c_custkey::VARCHAR, 9, '0')) AS n FROM f) SELECT c_custkey, CASE WHEN n = 1 THEN f ELSE f || '_' || n END AS file_name FROM r""")
def g7_file_names(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("a b/"), "c_mktsegment").alias("seg"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("k"))
    return ranges.file_names(c, "seg", "k").select("c_custkey", "file_name")


@query(f"""{views("genes")} SELECT gene_id, row_number() OVER (ORDER BY list_position(['chr3', 'chr1', 'chr2'], chr), "end", start)::BIGINT AS ord FROM genes WHERE chr IN ('chr1', 'chr2', 'chr3')""")
def o1_order_ranges(spark, d):
    return ranges.order_ranges(a.genes(spark, d), ["chr3", "chr1", "chr2"]).select("gene_id", F.col("ord").cast("bigint").alias("ord"))


@query(f"""{views("genes", "bl")} SELECT g.gene_id, b.id AS r_id FROM genes g JOIN bl b ON g.chr = b.chr AND g.start < b."end" AND g."end" > b.start""")
def j6_range_overlaps(spark, d):
    return ranges.range_join(a.genes(spark, d), a.blacklist(spark, d)).select("gene_id", "r_id")


@query(f"""{views("genes")}, nested AS (SELECT DISTINCT x.gene_id FROM genes x JOIN genes y ON x.chr = y.chr AND x.gene_id <> y.gene_id AND x.start >= y.start AND x."end" <= y."end"
 AND (y."end" - y.start > x."end" - x.start OR y.gene_id < x.gene_id)),
free AS (SELECT *, start + 1 - lag("end") OVER w AS b, lead(start) OVER w + 1 - "end" AS e FROM genes WHERE gene_id NOT IN (FROM nested) WINDOW w AS (PARTITION BY chr ORDER BY start, "end", gene_id)),
v AS (SELECT gene_id, strand, greatest(0, coalesce(b, 'inf'::DOUBLE)) AS b, greatest(0, coalesce(e, 'inf'::DOUBLE)) AS e FROM free)
SELECT gene_id, CASE WHEN strand THEN b ELSE e END AS upstream, CASE WHEN strand THEN e ELSE b END AS downstream FROM v UNION ALL SELECT gene_id, 0, 0 FROM nested""")
def j8_nearest_distance(spark, d):
    return ranges.distance_to_nearest(a.genes(spark, d), "gene_id")


@query()
def a14_merge_ranked(spark, d):
    return ranges.merge_ranked(a.peaks(spark, d), "peak_id")


# -- overlap matrices -----------------------------------------------------------------------------

_S = 'f.start >= p.start AND f.start < p."end"'
_E = 'f."end" > p.start AND f."end" <= p."end"'


@query(f"""{views("frags", "peaks")} SELECT peak_id, cell_id, sum(CASE WHEN {_S} THEN 1 ELSE 0 END + CASE WHEN {_E} THEN 1 ELSE 0 END)::BIGINT AS n
 FROM frags f JOIN peaks p ON f.chr = p.chr AND f.start < p."end" AND f."end" > p.start WHERE ({_S}) OR ({_E}) GROUP BY ALL""")
def j1_peak_insertions(spark, d):
    return overlap.peak_matrix(a.frags(spark, d), a.peaks(spark, d))


@query(f"""{views("frags", "peaks")} SELECT peak_id, cell_id, count(*) AS n FROM frags f JOIN peaks p ON f.chr = p.chr AND f.start < p."end" AND f."end" > p.start WHERE ({_S}) OR ({_E}) GROUP BY ALL""")
def j2_peak_fragments(spark, d):
    return overlap.peak_matrix(a.frags(spark, d), a.peaks(spark, d), "fragments")


@query(f"""{views("frags", "peaks")} SELECT peak_id, cell_id, count(*) AS n FROM frags f JOIN peaks p ON f.chr = p.chr AND f.start < p."end" AND f."end" > p.start GROUP BY ALL""")
def j3_peak_overlaps(spark, d):
    return overlap.peak_matrix(a.frags(spark, d), a.peaks(spark, d), "overlaps")


@query(f"""{views("frags", "sites", "regions")} SELECT region_id, ((pos - r.start) // 1000000)::INT AS tile_no, cell_id, count(*) AS n
 FROM sites s JOIN regions r ON s.chr = r.chr AND pos >= r.start AND pos < r."end" GROUP BY ALL""")
def j4_tile_insertions(spark, d):
    return overlap.tile_matrix(a.frags(spark, d), a.regions(spark, d))


@query(f"""{views("frags", "sites", "regions")} SELECT region_id, ((pos - r.start) // 1000000)::INT AS tile_no, cell_id, count(*) AS n
 FROM sites s JOIN regions r ON s.chr = r.chr AND pos >= r.start AND pos < r."end" WHERE is_start OR NOT (f_start >= r.start AND f_start < r."end") GROUP BY ALL""")
def j4_tile_fragments(spark, d):
    return overlap.tile_matrix(a.frags(spark, d), a.regions(spark, d), "fragments")


@query(f"""{views("regions")} SELECT chr, (start + t * 1000000)::INT AS start, least("end", start + (t + 1) * 1000000)::INT AS "end", region_id, t::INT AS tile_no
 FROM (SELECT *, unnest(range(0, (("end" - start - 1) // 1000000 + 1)::BIGINT)) AS t FROM regions)""")
def j5_tile_ranges(spark, d):
    return ranges.tile_ranges(a.regions(spark, d))


@query(f"""{views("frags", "cg", "genes", "sites")}, mid AS (SELECT chr, CASE WHEN strand THEN start ELSE "end" - 1 END AS c, strand FROM genes),
h AS (SELECT cell_group, CASE WHEN strand THEN pos - c ELSE c - pos END AS position, count(*)::DOUBLE * 0.5 AS n FROM sites s JOIN mid m ON s.chr = m.chr AND pos BETWEEN c - 125 AND c + 125 JOIN cg USING (cell_id) GROUP BY ALL),
g AS (SELECT cell_group, p::INT AS position FROM (SELECT DISTINCT cell_group FROM cg), range(-125, 126) t(p)),
f AS (SELECT cell_group, position, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (cell_group, position))
SELECT *, n / nullif(avg(n) FILTER (abs(position) > 113) OVER (PARTITION BY cell_group), 0) AS enrichment FROM f""")
def a11_footprint(spark, d):
    cells = a.cell_groups(spark, d).withColumn("weight", F.lit(0.5))
    return overlap.footprint(a.frags(spark, d), a.genes(spark, d), cells)


@query(f"""{views("frags", "sites", "genes", "bl")}, tss AS (SELECT DISTINCT chr, CASE WHEN strand THEN start ELSE "end" - 1 END AS p FROM genes),
w AS (SELECT chr, greatest(p - 50, 0) AS s, greatest(p - 50, 0) + 101 AS e, 'tss' AS o FROM tss
 UNION ALL SELECT chr, greatest(p + 1901, 0), greatest(p + 1901, 0) + 100, 'flank' FROM tss
 UNION ALL SELECT chr, greatest(p - 2000, 0), greatest(p - 2000, 0) + 100, 'flank' FROM tss
 UNION ALL SELECT chr, greatest(CASE WHEN strand THEN start - 2000 ELSE "end" - 101 END, 0), greatest(CASE WHEN strand THEN start - 2000 ELSE "end" - 101 END, 0) + 2101, 'promoter' FROM genes
 UNION ALL SELECT chr, start, "end", 'blacklist' FROM bl),
h AS (SELECT cell_id, count(*) FILTER (o = 'tss') AS t, count(*) FILTER (o = 'flank') AS f, count(*) FILTER (o = 'promoter') AS p, count(*) FILTER (o = 'blacklist') AS b FROM sites s JOIN w ON s.chr = w.chr AND pos >= w.s AND pos < w.e GROUP BY 1),
u AS (SELECT cell_id, count(*) FILTER (("end" - start) // 147 = 0) AS sub_nucleosomal, count(*) FILTER (("end" - start) // 147 = 1) AS mono_nucleosomal, count(*) FILTER (("end" - start) // 147 >= 2) AS multi_nucleosomal, count(*) AS n_fragments FROM frags GROUP BY 1)
SELECT cell_id, sub_nucleosomal, mono_nucleosomal, multi_nucleosomal, n_fragments, coalesce(t, 0) AS reads_in_tss, coalesce(f, 0) AS reads_flanking_tss, coalesce(p, 0) AS reads_in_promoter, coalesce(b, 0) AS reads_in_blacklist,
 coalesce(t, 0) / 101 / greatest(coalesce(f, 0) / 200, 0.1::DOUBLE) AS tss_enrichment FROM u LEFT JOIN h USING (cell_id)""")
def a12_cell_qc(spark, d):
    return atac.qc_cells(a.frags(spark, d), a.genes(spark, d), a.blacklist(spark, d))


@query()
def a13_call_peaks(spark, d):
    return atac.call_peaks(a.frags(spark, d), a.chrom_sizes(spark, d), a.cell_groups(spark, d), peak_width=2000, merge="all")


# the tiles of genes: 5 kb upstream, then up to the next gene, 1 to 100 kb
_TILES = views("genes", "sizes", "bl") + """, w AS (SELECT gene_id, chr, greatest(0, start - CASE WHEN strand THEN 5000 ELSE 0 END) AS s, least("end" + CASE WHEN strand THEN 0 ELSE 5000 END, coalesce(chr_size, 2147483647)) AS e, strand FROM genes LEFT JOIN sizes USING (chr)),
nested AS (SELECT DISTINCT x.gene_id FROM w x JOIN w y ON x.chr = y.chr AND x.gene_id <> y.gene_id AND x.s >= y.s AND x.e <= y.e AND x.s < y.e AND y.s < x.e AND (y.e - y.s > x.e - x.s OR y.gene_id < x.gene_id)),
free AS (SELECT gene_id, strand, greatest(0, coalesce(s + 1 - lag(e) OVER o, 'inf'::DOUBLE)) AS b, greatest(0, coalesce(lead(s) OVER o + 1 - e, 'inf'::DOUBLE)) AS n FROM w WHERE gene_id NOT IN (FROM nested) WINDOW o AS (PARTITION BY chr ORDER BY s, e, gene_id)),
gap AS (SELECT gene_id, CASE WHEN strand THEN b ELSE n END AS up, CASE WHEN strand THEN n ELSE b END AS down FROM free UNION ALL SELECT gene_id, 0, 0 FROM nested),
x AS (SELECT gene_id, least(greatest(up - {w}, 1000), 100000)::INT AS up, least(greatest(down - {w}, 1000), 100000)::INT AS down FROM gap),
r AS (SELECT w.gene_id, w.chr, s, e, strand, greatest(0, s - CASE WHEN strand THEN up ELSE down END) AS low, least(e + CASE WHEN strand THEN down ELSE up END, coalesce(chr_size, 2147483647)) AS high FROM w JOIN x USING (gene_id) LEFT JOIN sizes ON w.chr = sizes.chr),
t AS (SELECT gene_id, chr, s, e, strand, unnest(range(low // {w}, (high - 1) // {w} + 1))::INT AS tile FROM r),
gt AS (SELECT gene_id, chr, tile, ((CASE WHEN tile * {w} >= e THEN tile * {w} + 1 - e ELSE least(0, tile * {w} + {w} - 1 - s) END) * CASE WHEN strand THEN 1 ELSE -1 END)::INT AS distance FROM t)"""
_WEIGHTS = _TILES + """, i AS (SELECT gene_id, 1.0::DOUBLE / ("end" - start + 5000) AS inv FROM genes), h AS (SELECT max(inv) AS hi, min(inv) AS lo FROM i),
gw AS (SELECT gene_id, chr, tile, (exp(-abs(distance - sign(distance)) / 5000.0::DOUBLE) + exp(-1.0::DOUBLE)) * CASE WHEN hi > lo THEN 1 + inv * 4 / (hi - lo) ELSE 1 END AS weight FROM gt JOIN i USING (gene_id), h
 WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.chr = gt.chr AND bl.start < (gt.tile + 1) * {w} AND bl."end" > gt.tile * {w}))"""


@query(
    _WEIGHTS.replace("{w}", "500") + ", " + a.VIEWS["frags"] + ", " + a.VIEWS["sites"] + """, n AS (SELECT s.chr, (pos // 500)::INT AS tile, cell_id, least(count(*), 4) AS n FROM sites s JOIN sizes USING (chr) WHERE pos < chr_size GROUP BY ALL),
 sc AS (SELECT gene_id, cell_id, sum(n * weight) AS score FROM n JOIN gw USING (chr, tile) GROUP BY ALL) SELECT gene_id, cell_id, round(score * 10000 / sum(score) OVER (PARTITION BY cell_id), 6) AS score FROM sc"""
)
def a15_gene_scores(spark, d):
    out = atac.gene_scores(a.frags(spark, d), a.genes(spark, d), a.chrom_sizes(spark, d), a.blacklist(spark, d))
    return out.withColumn("score", F.round("score", 6))


@query(_WEIGHTS.replace("{w}", "5000") + " SELECT gene_id, chr, tile, round(weight, 9) AS weight FROM gw")
def a16_gene_weights(spark, d):
    return atac.gene_weights(a.genes(spark, d), a.chrom_sizes(spark, d), a.blacklist(spark, d), tile_width=5000).withColumn("weight", F.round("weight", 9))


@query(_TILES.replace("{w}", "5000") + " SELECT * FROM gt")
def a17_gene_tiles(spark, d):
    return atac.gene_tiles(a.genes(spark, d), a.chrom_sizes(spark, d), tile_width=5000)


@query(f"""{views("frags", "sites", "cg")}, c AS (SELECT cell_group, count(*) AS reads FROM frags JOIN cg USING (cell_id) GROUP BY 1),
h AS (SELECT cell_group, ((pos - 1000000) // 100000)::INT AS bin, count(*) AS n FROM sites JOIN cg USING (cell_id) WHERE chr = 'chr1' AND pos >= 1000000 AND pos < 51000000 GROUP BY ALL),
g AS (SELECT cell_group, reads, b::INT AS bin FROM c, range(0, 500) t(b))
SELECT cell_group, bin, (bin * 100000 + 1000000)::INT AS start, (bin * 100000 + 1100000)::INT AS "end", coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) * (1e9::DOUBLE / 100000) / reads AS normalized FROM g LEFT JOIN h USING (cell_group, bin)""")
def a18_track_coverage(spark, d):
    f = a.frags(spark, d)
    cells = f.groupBy("cell_id").agg(F.count(F.lit(1)).alias("reads")).join(a.cell_groups(spark, d), "cell_id")
    return overlap.track_coverage(f, ("chr1", 1_000_000, 51_000_000), cells)


@query(f"""{views("frags", "sites", "cg", "peaks")} SELECT peak_id AS region_id, cell_group, ((pos - p.start) // 100)::INT AS bin, count(*) AS n
 FROM sites s JOIN cg USING (cell_id) JOIN peaks p ON s.chr = p.chr AND pos >= p.start AND pos < p.start + 5000 GROUP BY ALL""")
def a23_region_coverage(spark, d):
    r = a.peaks(spark, d).select(F.col("peak_id").alias("region_id"), "chr", "start", (F.col("start") + 5000).alias("end"))
    return overlap.region_coverage(a.frags(spark, d), r, a.cell_groups(spark, d), 100)


@query(f"{views('frags', 'sites', 'cg')} SELECT cell_group, chr, pos AS start, pos + 1 AS \"end\" FROM sites JOIN cg USING (cell_id)")
def k11_insertion_bed(spark, d):
    s = fragments.insertions(a.frags(spark, d).select("chr", "start", "end", "cell_id")).select("chr", "pos", "cell_id").join(ranges.checked_broadcast(a.cell_groups(spark, d)), "cell_id")
    return s.select("cell_group", "chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))


_BEDGRAPH = """t AS (SELECT cell_group, s.chr, (pos // 1000 * 1000)::INT AS start, count(*) AS n FROM sites s JOIN cg USING (cell_id) GROUP BY ALL)"""


@query(f"""{views("frags", "sites", "cg", "sizes")}, {_BEDGRAPH}, c AS (SELECT cell_group, 1e6::DOUBLE / sum(n) AS f FROM t GROUP BY 1)
 SELECT cell_group, chr, start, least(start + 1000, chr_size)::INT AS "end", n * f AS score FROM t JOIN c USING (cell_group) JOIN sizes USING (chr) WHERE start < chr_size""")
def k12_bedgraph_cpm(spark, d):
    return overlap.insertion_bedgraph(a.frags(spark, d), a.cell_groups(spark, d), 1000, "cpm", chrom_sizes=a.chrom_sizes(spark, d))


@query(f"""{views("frags", "sites", "cg")}, {_BEDGRAPH}, c AS (SELECT cell_group, count(*) AS k FROM cg GROUP BY 1)
 SELECT cell_group, chr, start, start + 1000 AS "end", n * (1.0::DOUBLE / k) AS score FROM t JOIN c USING (cell_group)""")
def k12_bedgraph_per_cell(spark, d):
    return overlap.insertion_bedgraph(a.frags(spark, d), a.cell_groups(spark, d), 1000, "n_cells")


@query(f"{views('frags', 'sites', 'cg')} SELECT cell_group, chr, pos, count(*) AS n FROM sites JOIN cg USING (cell_id) GROUP BY ALL")
def k16_insertion_counts(spark, d):
    return overlap.insertion_counts(a.frags(spark, d), a.cell_groups(spark, d))


# -- annotation -----------------------------------------------------------------------------------

_GTF_OK = r"""g AS (SELECT string_split(regexp_replace(line, '\r$', ''), chr(9)) AS f FROM gtf WHERE NOT starts_with(line, '#')),
ok AS (SELECT f FROM g WHERE len(f) = 9 AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[5], '[0-9]+')
 AND regexp_full_match(f[9], '[^ ";]+ ([0-9]+|"[^"]*")(; [^ ";]+ ([0-9]+|"[^"]*"))*;?')),
gs AS (SELECT f FROM ok WHERE f[4]::HUGEINT >= 1 AND f[4]::HUGEINT <= f[5]::HUGEINT AND f[5]::HUGEINT <= 2147483647)"""


@query(rf"""WITH {_GTF_OK} SELECT f[1] AS chr, f[2] AS source, f[3] AS feature, (f[4]::INT - 1)::INT AS start, f[5]::INT AS "end", f[6] AS score, f[7] <> '-' AS strand, f[8] AS frame,
 nullif(regexp_extract(f[9], '(?:^|; ?)gene_id "([^"]*)"', 1), '') AS gene_id, nullif(regexp_extract(f[9], '(?:^|; ?)gene_name "([^"]*)"', 1), '') AS gene_name, contains(f[9], 'tag "basic"') AS basic
 FROM gs WHERE f[3] IN ('gene', 'transcript')""")
def s15_gtf_features(spark, d):
    return gtf_features(valid_records(load_records(table(spark, d, "gtf"), "gtf")), ("gene", "transcript"), ("gene_id", "gene_name"), ("basic",))


@query(rf"""WITH {_GTF_OK} SELECT nullif(regexp_extract(f[9], '(?:^|; ?)gene_id "([^"]*)"', 1), '') AS gene_id, f[1] AS chr FROM gs
 WHERE f[3] = 'gene' AND regexp_full_match(nullif(regexp_extract(f[9], '(?:^|; ?)gene_type "([^"]*)"', 1), ''), 'lncRNA|protein_coding')""")
def s16_genes_of_type(spark, d):
    return gtf_features(valid_records(load_records(table(spark, d, "gtf"), "gtf")), gene_type="lncRNA|protein_coding").select("gene_id", "chr")


@query("SELECT chr, 0 AS start, chr_size::INT AS \"end\" FROM chrom_sizes WHERE regexp_full_match(chr, 'chr[0-9]+|chrX|chrY')")
def s20_chrom_sizes(spark, d):
    return whole_chromosomes(a.chrom_sizes(spark, d))


# -- matrices -------------------------------------------------------------------------------------


def _entries(m: matrix.SparseMatrix) -> DataFrame:
    return m.entries.select("row", "col", "val")


def _elementwise(name: str, sql: str, f: Callable[[matrix.SparseMatrix], matrix.SparseMatrix]) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _entries(f(a.counts(spark, d))).select("row", "col", F.round("val", 9).alias("val"))

    q.__name__ = name
    query(f"{views('m')} SELECT r AS row, c AS col, round({sql}, 9) AS val FROM m WHERE ({sql}) <> 0")(q)


_elementwise("t1_log1p", "ln(1 + v)", lambda m: m.log1p())
_elementwise("t2_expm1", "exp(v / 100) - 1", lambda m: m.scale(0.01).expm1())
_elementwise("t3_square", "v * v", lambda m: m.power(2))
_elementwise("t4_power", "sqrt(v)", lambda m: m.power(0.5))
_elementwise("t5_min_scalar", "least(v, 30.0::DOUBLE)", lambda m: m.min_scalar(30))
_elementwise("t8_binarize", "CASE WHEN v > 30 THEN 1.0::DOUBLE ELSE 0 END", lambda m: m.binarize(30))
_elementwise("t9_greater_equal", "CASE WHEN v >= 30 THEN 1.0::DOUBLE ELSE 0 END", lambda m: m >= 30)
_elementwise("t10_round", "round_even(v / 8, 0)", lambda m: m.scale(1 / 8).round())
_elementwise("t11_scale", "v * 0.125", lambda m: m.scale(0.125))
_elementwise("m6_cast", "trunc(v / 16)", lambda m: m.scale(1 / 16).cast_whole())


@query(f"{views('m', 'rv')} SELECT m.r AS row, m.c AS col, least(v, x) AS val FROM m JOIN rv ON m.r = rv.r")
def t6_min_by_row(spark, d):
    return _entries(a.counts(spark, d).min_by("row", a.row_vector(spark, d)))


@query(f"{views('m', 'cv')} SELECT m.r AS row, m.c AS col, least(v, x) AS val FROM m JOIN cv ON m.c = cv.c")
def t7_min_by_col(spark, d):
    return _entries(a.counts(spark, d).min_by("col", a.col_vector(spark, d)))


@query(f"{views('m', 'rv')} SELECT m.r AS row, m.c AS col, v * x AS val FROM m JOIN rv ON m.r = rv.r")
def t11_multiply_rows(spark, d):
    return _entries(a.counts(spark, d).multiply_by("row", a.row_vector(spark, d)))


_SHIFTED = "x AS (SELECT rv.r, cv.c, coalesce(v, 0) + rv.x + cv.x + 0.5 AS v FROM rv CROSS JOIN cv LEFT JOIN m ON m.r = rv.r AND m.c = cv.c)"


def _shifted(spark, d):
    return a.counts(spark, d).add(0.5).add_by("row", a.row_vector(spark, d)).add_by("col", a.col_vector(spark, d))


@query(f"{views('m', 'rv', 'cv')}, {_SHIFTED} SELECT r AS row, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, round(var_samp(v), 6) AS variance FROM x GROUP BY r")
def t12_shifted_stats(spark, d):
    return stats.axis_stats(_shifted(spark, d), "row").select("row", *[F.round(c, 6).alias(c) for c in ("total", "mean", "variance")])


@query(f"{views('m', 'rv', 'cv')}, {_SHIFTED} SELECT x.r AS idx, round(sum(v * cv.x), 6) AS v FROM x JOIN cv ON x.c = cv.c GROUP BY x.r")
def t12_shifted_product(spark, d):
    return _shifted(spark, d).times_vector(a.col_vector(spark, d)).select("idx", F.round("v", 6).alias("v"))


@query(f"""{views('m', 'rv', 'cv')}, z AS (SELECT rv.r, least(greatest((coalesce(v, 0) - 0.01 * (rv.x + 1) * cv.x) * least(1 / sqrt(0.01 * (rv.x + 1) * cv.x + (0.01 * (rv.x + 1) * cv.x) ** 2 / 2.0), 5.0), -2.0), 8.0)::DOUBLE AS v
 FROM rv CROSS JOIN cv LEFT JOIN m ON m.r = rv.r AND m.c = cv.c) SELECT r AS row, round(avg(v), 7) AS mean, round(var_samp(v), 6) AS variance FROM z GROUP BY r""")
def t14_pearson_residuals(spark, d):
    g = a.row_vector(spark, d).select("idx", F.lit(2.0).alias("theta"), (0.01 * (F.col("v") + 1)).alias("beta"))
    cells = a.col_vector(spark, d).select("idx", F.col("v").alias("reads"))
    out = linalg.pearson_residual_stats(a.counts(spark, d), g, cells, min_var=0.04, clip=(-2.0, 8.0))
    return out.select("row", F.round("mean", 7).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"""{views('m', 'cv', 'dims')}, k AS (SELECT count(*) AS n, avg(x) AS mx, sum((x - (SELECT avg(x) FROM cv)) ** 2) AS sxx FROM cv),
b AS (SELECT r, sum(v) / (SELECT n FROM k) AS my, sum(v * (x - (SELECT mx FROM k))) / (SELECT sxx FROM k) AS slope FROM m JOIN cv ON m.c = cv.c GROUP BY r)
SELECT b.r AS row, cv.c AS col, round(coalesce(v, 0) - my - slope * (cv.x - (SELECT mx FROM k)), 6) + 0 AS val FROM b CROSS JOIN cv LEFT JOIN m ON m.r = b.r AND m.c = cv.c""")
def t15_regress_out(spark, d):
    out = linalg.regress_out(a.counts(spark, d), a.col_vector(spark, d))
    return out.select("row", "col", (F.round("val", 6) + 0).alias("val"))


@query(f"{views('m')} SELECT 2 - r // 5 AS row, c // 3 AS col, v AS val FROM m WHERE r IN (0, 5, 10) AND c % 3 = 0 AND c < 90")
def m1_select(spark, d):
    m = a.counts(spark, d)
    return _entries(m.select([10, 5, 0], list(range(0, min(90, m.ncol), 3))))


@query(f"{views('m')} SELECT r AS row, c - 20 AS col, v AS val FROM m WHERE c >= 20 AND c < 60")
def m2_col_slice(spark, d):
    return _entries(a.counts(spark, d).col_slice(20, 60))


@query(f"{views('m')} SELECT r AS row, c AS col, v AS val FROM m WHERE NOT (r IN (1, 3, 5) AND c IN (2, 4)) UNION ALL SELECT r + 1, c + 2, v * 10 FROM m WHERE r IN (0, 2, 4) AND c IN (0, 2)")
def m3_assign(spark, d):
    m = a.counts(spark, d)
    return _entries(m.assign([1, 3, 5], [2, 4], m.select([0, 2, 4], [0, 2]).scale(10)))


@query(f"{views('m')} SELECT c AS row, r AS col, v AS val FROM m")
def m5_transpose(spark, d):
    return _entries(a.counts(spark, d).t)


@query(f"{views('m')} SELECT r AS row, c AS col, v AS val FROM m WHERE v <= 40")
def m7_mask(spark, d):
    m = a.counts(spark, d)
    return _entries(m.mask(m > 40))


@query(f"{views('m', 'dims')} SELECT c AS col, coalesce(f0, 0) AS f0, coalesce(f7, 0) AS f7 FROM (SELECT range AS c FROM dims, range(0, nc)) LEFT JOIN (SELECT c, max(v) FILTER (r = 0) AS f0, max(v) FILTER (r = 7) AS f7 FROM m GROUP BY c) USING (c)")
def m12_feature_table(spark, d):
    return plotdata.feature_table(a.counts(spark, d), [0, 7])


@query(f"{views('m')} SELECT least(v::BIGINT, 81) AS value, count(*) AS n FROM m GROUP BY 1")
def m15_value_histogram(spark, d):
    return matrix.value_histogram(a.counts(spark, d), 80)


@query(_PAIRS.format(v=views("m"), name="m", cols="r, c, v", other="r, c, v"))
def m16_identical(spark, d):
    m = a.counts(spark, d)
    return matrix.same(m, m.t.t)


@query(_PAIRS.format(v=views("m"), name="m", cols="r, c, v", other="r, c, least(v, 40)"))
def m16_unequal(spark, d):
    m = a.counts(spark, d)
    return matrix.same(m, m.min_scalar(40))


_MD5 = """{v}, l AS (SELECT 0 AS part, {by} AS idx, md5(string_agg({other} || ':' || v::VARCHAR, ',' ORDER BY {other})) AS d FROM m GROUP BY {by}
 UNION ALL SELECT 1, p_partkey, md5(p_name) FROM part UNION ALL SELECT 2, s_suppkey, md5(s_name) FROM supplier),
b AS (SELECT part, idx // 1024 AS b, md5(string_agg(idx || '=' || d, ';' ORDER BY idx)) AS d FROM l GROUP BY ALL)
SELECT md5('{order}|' || nr || '|' || nc || '|' || (SELECT string_agg(d, ';' ORDER BY part, b) FROM b)) AS md5 FROM dims"""


def _md5(spark, d, by):
    rows, cols = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name"))
    return matrix.checksum(a.counts(spark, d), by, rows, cols)


@query(_MD5.format(v=views("m", "dims"), by="c", other="r", order="col"))
def a24_checksum(spark, d):
    return _md5(spark, d, "col")


@query(_MD5.format(v=views("m", "dims"), by="r", other="c", order="row"))
def a24_checksum_by_row(spark, d):
    return _md5(spark, d, "row")


@query(f"{views('m')} SELECT r AS row, c AS col, CASE WHEN r IN (1, 3, 5) AND c IN (2, 4) THEN 9.0 ELSE v + 1 END AS val FROM m UNION ALL SELECT r, c, 9.0 FROM (VALUES (1), (3), (5)) a(r), (VALUES (2), (4)) b(c) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.r = a.r AND m.c = b.c)")
def m3_assign_with_shift(spark, d):
    """A constant block in a matrix with a dense term: its stored elements and the block."""
    nine = matrix.SparseMatrix(spark.createDataFrame([], "row bigint, col bigint, val double"), 3, 2).add(9)
    m = a.counts(spark, d)
    out = m.add(1).assign([1, 3, 5], [2, 4], nine)
    block = F.col("row").isin(1, 3, 5) & F.col("col").isin(2, 4)
    cells = m.entries.select("row", "col").union(m.entries.sparkSession.createDataFrame([(r, c) for r in (1, 3, 5) for c in (2, 4)], "row bigint, col bigint")).distinct()
    at = cells.join(out.entries, ["row", "col"], "left")
    return at.select("row", "col", F.when(block, F.coalesce("val", F.lit(0.0)) + out.shift).otherwise(F.col("val") + out.shift).alias("val"))


@query(f"{views('m', 'rv', 'cv')} SELECT r AS row, c AS col, v + x + 1 AS val FROM m JOIN rv USING (r) WHERE v > 40")
def m7_mask_with_shift(spark, d):
    """What is left where another matrix isn't zero, of a matrix with dense terms."""
    m = a.counts(spark, d)
    return _entries(m.add_by("row", a.row_vector(spark, d)).add(1).mask(m > 40, invert=True))


@query(f"{views('m', 'rv')} SELECT r AS row, c AS col, round(v / 4 / (x + 1), 9) AS val FROM m JOIN rv USING (r)")
def t13_divide(spark, d):
    v = a.row_vector(spark, d).withColumn("v", F.col("v") + 1)
    return (a.counts(spark, d) / 4).divide_by("row", v).entries.select("row", "col", F.round("val", 9).alias("val"))


@query(f"{views('m')} SELECT r AS row, c AS col, 2 * v + 1 AS val FROM m")
def m11_replaced_input(spark, d):
    m = a.counts(spark, d)
    plan = matrix.MatrixPlan((m,), lambda x: x.scale(2)).with_inputs(m.scale(3))
    back = plan.with_inputs(*[x.scale(1 / 3) for x in plan.inputs]).result()
    return back.entries.select("row", "col", (F.round("val", 6) + 1).alias("val"))


@query(f"""{views('m', 'dims')}, s AS (SELECT r, sum(v) / nc AS mean, (sum(v * v) - sum(v) ** 2 / nc) / (nc - 1) AS var FROM m, dims GROUP BY r, nc)
SELECT r AS row FROM s ORDER BY round(var, 6) DESC, r LIMIT 50""")
def o2_top_features(spark, d):
    return stats.top_features(a.counts(spark, d), 50).select("row")


@query("SELECT round(sqrt(count(*)), 6) AS d, 1.0::DOUBLE AS u_norm FROM orders GROUP BY o_orderpriority")
def l1_group_values(spark, d):
    """Singular values of an indicator matrix are the roots of the group sizes."""
    return _indicator_values(spark, d, linalg.GRAM_SIDE)


@query("SELECT round(sqrt(count(*)), 6) AS d, 1.0::DOUBLE AS u_norm FROM orders GROUP BY o_orderpriority")
def l1_group_values_iterated(spark, d):
    """The same by passes over the rows."""
    return _indicator_values(spark, d, 0)


def _indicator_values(spark, d, gram_side):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.substring("o_orderpriority", 1, 1).cast("bigint") - 1).alias("col"), F.lit(1.0).alias("val"))
    u, s, v = linalg.svds(matrix.SparseMatrix(o, table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1, 5), 5, gram_side)
    norms = u.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("u_norm"))
    values = spark.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "k int, d double")
    return norms.join(values, "k").select(F.round("d", 6).alias("d"), "u_norm")


@query(f"{views('mg')} SELECT c AS row, list_position(['g0', 'g1', 'g2', 'g3', 'g4'], cell_group)::BIGINT - 1 AS col, 1.0::DOUBLE AS val FROM mg")
def a25_membership(spark, d):
    return _entries(matrix.membership(a.groups(spark, d), [f"g{k}" for k in range(5)]))


@query(f"{views('m', 'dims')} SELECT r AS row, c AS col, v AS val FROM m UNION ALL SELECT r + nr, c, v * 2 FROM m, dims")
def u2_bind_rows(spark, d):
    m = a.counts(spark, d)
    return _entries(m.bind_rows(m.scale(2)))


@query(f"{views('m', 'dims')} SELECT r AS row, c AS col, v AS val FROM m UNION ALL SELECT r, c + nc, v * 2 FROM m, dims")
def u2_bind_cols(spark, d):
    m = a.counts(spark, d)
    return _entries(m.bind_cols(m.scale(2)))


_AXES = {"row": ("r", "nr", "nc"), "col": ("c", "nc", "nr")}


def _axis_queries() -> None:
    for axis, (x, own, other) in _AXES.items():
        every = f"e AS (SELECT range AS {x} FROM dims, range(0, {own}))"
        full = f"f AS (SELECT e.{x}, o.v FROM e LEFT JOIN m o ON o.{x} = e.{x})"

        def q1(spark, d, axis=axis):
            return stats.axis_stats(a.counts(spark, d), axis).select(axis, "nonzero", "total", F.round("mean", 9).alias("mean"), F.round("variance", 8).alias("variance"))

        q1.__name__ = f"a5_{axis}_stats"
        query(f"""{views('m', 'dims')}, {every}, {full} SELECT {x} AS {axis}, count(v) AS nonzero, coalesce(sum(v), 0) AS total, round(coalesce(sum(v), 0) / (SELECT {other} FROM dims), 9) AS mean,
 round((coalesce(sum(v * v), 0) - coalesce(sum(v), 0) ** 2 / (SELECT {other} FROM dims)) / ((SELECT {other} FROM dims) - 1), 8) AS variance FROM f GROUP BY {x}""")(q1)

        def q2(spark, d, axis=axis):
            return stats.axis_max(a.counts(spark, d), axis)

        q2.__name__ = f"a4_{axis}_max"
        query(f"{views('m', 'dims')}, {every}, {full} SELECT {x} AS {axis}, greatest(coalesce(max(v), 0), 0) AS max FROM f GROUP BY {x}")(q2)

        def q3(spark, d, axis=axis):
            return stats.axis_quantiles(a.counts(spark, d), axis, [0.0, 0.25, 0.5, 0.9, 1.0]).select(axis, "prob", F.round("quantile", 9).alias("quantile"))

        q3.__name__ = f"a6_{axis}_quantiles"
        across = "c" if x == "r" else "r"
        query(f"""{views('m', 'dims')}, e AS (SELECT i AS r, j AS c FROM dims, range(0, nr) t(i), range(0, nc) s(j)), f AS (SELECT e.{x}, coalesce(v, 0) AS v FROM e LEFT JOIN m ON m.r = e.r AND m.c = e.c),
 l AS (SELECT {x}, quantile_cont(v, [0.0, 0.25, 0.5, 0.9, 1.0]) AS q FROM f GROUP BY {x}) SELECT {x} AS {axis}, p::DOUBLE AS prob, round(v, 9) AS quantile FROM (SELECT {x}, unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS p, unnest(q) AS v FROM l)""")(q3)


_axis_queries()


@query(f"""{views('m', 'mg')}, n AS (SELECT cell_group, count(*) AS n FROM mg GROUP BY 1), s AS (SELECT r, cell_group, count(*) AS k, sum(v) AS s, sum(v * v) AS ss FROM m JOIN mg USING (c) GROUP BY ALL)
SELECT r AS row, cell_group, k AS nonzeros, s AS total, round(s / n, 9) AS mean, CASE WHEN n > 1 THEN round((ss - s * s / n) / (n - 1), 8) END AS variance FROM s JOIN n USING (cell_group)""")
def a7_pseudobulk(spark, d):
    return stats.pseudobulk(a.counts(spark, d), a.groups(spark, d)).withColumns({"mean": F.round("mean", 9), "variance": F.round("variance", 8)})


_DENSE = "d AS (SELECT e.r, e.c, coalesce(v, 0) AS v FROM (SELECT i AS r, j AS c FROM dims, range(0, nr) t(i), range(0, nc) s(j)) e LEFT JOIN m ON m.r = e.r AND m.c = e.c)"
_RANKED = """k AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY v) + (count(*) OVER (PARTITION BY r, v) - 1) / 2 AS rk FROM d),
z AS (SELECT r, max(rk) FILTER (v = 0) AS zr FROM k GROUP BY r)"""


@query(f"{views('m', 'dims')}, {_DENSE}, {_RANKED} SELECT r AS row, c AS col, (rk - coalesce(zr, 0))::DOUBLE AS val FROM k JOIN z USING (r) WHERE rk - coalesce(zr, 0) <> 0")
def w1_rank_transform(spark, d):
    return _entries(stats.rank_transform(a.counts(spark, d), "row"))


@query(f"{views('m', 'dims')}, {_DENSE} SELECT r AS row, sum(t * t * t - t)::BIGINT AS ties FROM (SELECT r, v, count(*) AS t FROM d GROUP BY ALL) GROUP BY r")
def w2_tie_statistics(spark, d):
    return stats.tie_statistics(a.counts(spark, d), "row")


@query(f"""{views('m', 'dims', 'mg')}, {_DENSE}, {_RANKED}, g AS (SELECT r, cell_group, count(*) AS n1, sum(rk) AS rg, sum(v) AS sg FROM k JOIN mg USING (c) GROUP BY ALL),
t AS (SELECT r, count(*) AS n, sum(rk) AS rt, sum(v) AS st FROM k GROUP BY r), tie AS (SELECT r, sum(t * t * t - t) AS ties FROM (SELECT r, v, count(*) AS t FROM d GROUP BY ALL) GROUP BY r),
u AS (SELECT r, cell_group, n, n1, n - n1 AS n2, ties, rg - n1 * (n1 + 1) / 2 AS u1, (rt - rg) - (n - n1) * (n - n1 + 1) / 2 AS u2, sg, st FROM g JOIN t USING (r) JOIN tie USING (r)),
s AS (SELECT *, greatest(u1, u2) AS um, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1.0::DOUBLE)))) AS sd FROM u)
SELECT r AS row, cell_group, round(u1, 6) AS u, round(sg / n1, 9) AS foreground_mean, round((st - sg) / n2, 9) AS background_mean,
 round(CASE WHEN sd > 0 THEN (um - CASE WHEN um > n1 * n2 / 2 THEN 0.5 ELSE 0 END - n1 * n2 / 2) / sd ELSE 0 END, 7) AS z FROM s""")
def a8_marker_features(spark, d):
    out = stats.marker_features(a.counts(spark, d), a.groups(spark, d), with_p=False)
    return out.select("row", "cell_group", F.round("u", 6).alias("u"), F.round("foreground_mean", 9).alias("foreground_mean"), F.round("background_mean", 9).alias("background_mean"), F.round("z", 7).alias("z"))


@query()
def a8_marker_p_values(spark, d):
    return stats.marker_features(a.counts(spark, d), a.groups(spark, d)).select("row", "cell_group", "z", "p_val")


@query("""WITH p AS (SELECT c_custkey, c_mktsegment AS seg, (c_custkey * 7919 % 10007 + 1) / 10008 AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY p) AS k, count(*) OVER (PARTITION BY seg) AS n FROM p)
SELECT c_custkey, round(least(1, min(n / k * p) OVER (PARTITION BY seg ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 12) AS q FROM r""")
def w4_benjamini_hochberg(spark, d):
    from ..functions.tails import benjamini_hochberg
    from pyspark.sql.window import Window

    p = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), ((F.col("c_custkey") * 7919 % 10007 + 1) / 10008).alias("p"))
    p = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seg")))
    return benjamini_hochberg(p, ["seg"], "p", "n").select("c_custkey", F.round("q", 12).alias("q"))


@query("""SELECT c_custkey, round(CASE WHEN count(*) OVER w = 5 THEN avg(c_acctbal) OVER w END, 6) AS smooth FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w5_rolling_mean(spark, d):
    return stats.rolling_mean(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", "c_acctbal", 5, "smooth").select("c_custkey", F.round("smooth", 6).alias("smooth"))


@query(f"{views('m')} SELECT a.c AS row, b.c AS col, sum(a.v * b.v) AS val FROM m a JOIN m b USING (r) GROUP BY ALL")
def j9_sparse_product(spark, d):
    m = a.counts(spark, d)
    return _entries(m.t.multiply(m))


@query(f"{views('m', 'cv', 'dims')} SELECT e.r AS idx, coalesce(sum(v * x), 0) AS v FROM (SELECT range AS r FROM dims, range(0, nr)) e LEFT JOIN m ON m.r = e.r LEFT JOIN cv ON m.c = cv.c GROUP BY e.r")
def j11_matrix_vector(spark, d):
    return a.counts(spark, d).times_vector(a.col_vector(spark, d))


@query(f"""{views('m', 'cv', 'dims')} SELECT e.r AS idx, coalesce(sum(v * x), 0) AS first, coalesce(sum(v * x * x), 0) AS second FROM (SELECT range AS r FROM dims, range(0, nr)) e LEFT JOIN m ON m.r = e.r LEFT JOIN cv ON m.c = cv.c GROUP BY e.r""")
def j10_matrix_dense(spark, d):
    dense = a.col_vector(spark, d).select("idx", F.array("v", F.col("v") * F.col("v")).alias("vector"))
    return a.counts(spark, d).times_dense(dense, 2).select("idx", F.col("vector")[0].alias("first"), F.col("vector")[1].alias("second"))


@query(f"{views('m')} SELECT p_name || p_partkey AS row_name, s_name AS col_name, v AS val FROM m JOIN part ON r = p_partkey JOIN supplier ON c = s_suppkey")
def m4_named_entries(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("name"))
    return matrix.named_entries(a.counts(spark, d), r, c)


@query(f"{views('m', 'dims')} SELECT r AS row, c AS col, v AS val FROM (SELECT nr - 1 - r AS r, c // 2 AS c, v, nr FROM m, dims WHERE c % 2 = 0) WHERE r < nr")
def m13_array_index(spark, d):
    return _entries(a.counts(spark, d)[::-1, ::2])


@query(f"{views('m', 'dims')} SELECT e.r AS row, count(v) AS n, coalesce(sum(v), 0) AS total FROM (SELECT range AS r FROM dims, range(0, nr)) e LEFT JOIN m ON m.r = e.r GROUP BY e.r")
def udf_apply_by_row(spark, d):
    return matrix.apply_by(a.counts(spark, d), "row", lambda i, c, v: {"n": len(v), "total": float(v.sum())}, "n bigint, total double")


@query(f"{views('sizes')}, t AS (SELECT chr, ceil(chr_size / 500)::BIGINT AS n_tiles FROM sizes) SELECT chr, coalesce(sum(n_tiles) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_tile, n_tiles FROM t")
def w7_tile_offsets(spark, d):
    return overlap.tile_offsets(a.chrom_sizes(spark, d), 500)


@query(f"""{views("frags", "sites", "cg", "peaks")} SELECT peak_id AS region_id, cell_group, ((pos - p.start) // 100)::INT AS bin, count(*) AS n
 FROM sites s JOIN cg USING (cell_id) JOIN peaks p ON s.chr = p.chr AND pos >= p.start AND pos < p.start + 5000 GROUP BY ALL""")
def a23_stored_counts(spark, d):
    r = a.peaks(spark, d).select(F.col("peak_id").alias("region_id"), "chr", "start", (F.col("start") + 5000).alias("end"))
    return overlap.counts_in_regions(overlap.insertion_counts(a.frags(spark, d), a.cell_groups(spark, d)), r, 100)


@query()
def l9_seurat(spark, d):
    return graph.cluster_seurat(table(spark, d, "knn_to_geodesic_graph").where("weight <= 1"))


@query()
def l1_svd(spark, d):
    u, s, v = linalg.svds(a.counts(spark, d), 8)
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    return u.agg(F.sum(norm).alias("u_norm"), F.count(F.lit(1)).alias("n")).select("n", F.round("u_norm", 6).alias("u_norm"), F.array(*[F.lit(float(x)) for x in s]).alias("d"))


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_KNN = """k AS (SELECT a.vec_id AS i, b.vec_id AS idx, row_number() OVER (PARTITION BY a.vec_id ORDER BY {m}, a.vec_id <> b.vec_id, b.vec_id) AS nn_rank, {m} AS dist FROM embeddings a, embeddings b)"""
_EUCLID = "CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END"


@query(f"WITH {_KNN.format(m=_EUCLID)} SELECT i, nn_rank::INT AS nn_rank, idx, round(dist, 5) AS dist FROM k WHERE nn_rank <= 10")
def l2_knn_euclidean(spark, d):
    return graph.exact_neighbours(_embeddings(spark, d)).withColumn("dist", F.round("dist", 5))


@query(f"WITH {_KNN.format(m='CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END')} SELECT i, nn_rank::INT AS nn_rank, idx, round(dist, 5) AS dist FROM k WHERE nn_rank <= 10")
def l3_knn_cosine(spark, d):
    return graph.exact_neighbours(_embeddings(spark, d), metric="cosine").withColumn("dist", F.round("dist", 5))


_STORED = "s AS (SELECT DISTINCT i, nn_rank, idx, dist FROM knn WHERE i IS NOT NULL AND idx IS NOT NULL AND dist IS NOT NULL)"


def _stored_knn(spark, d):
    return table(spark, d, "knn").where("i is not null and idx is not null and dist is not null").select("i", "nn_rank", "idx", "dist").distinct()


@query(f"WITH {_STORED} SELECT i, idx AS j, dist AS weight FROM s WHERE i <> idx")
def l4_knn_graph(spark, d):
    return graph.knn_to_graph(_stored_knn(spark, d), use_weights=True, self_loops=False)


@query(f"WITH {_STORED}, e AS (SELECT DISTINCT i, idx FROM s), c AS (SELECT a.i, b.i AS j, count(*) AS c FROM e a JOIN e b USING (idx) WHERE a.i > b.i GROUP BY ALL) SELECT i, j, c / (20 - c) AS weight FROM c WHERE c >= 2")
def l5_snn_graph(spark, d):
    return graph.knn_to_snn(_stored_knn(spark, d), 10)


@query()
def l6_geodesic_graph(spark, d):
    return graph.knn_to_geodesic(_stored_knn(spark, d))


@query()
def l7_leiden(spark, d):
    return graph.communities(table(spark, d, "knn_to_geodesic_graph").where("weight <= 1"))


@query()
def l8_louvain(spark, d):
    return graph.communities(table(spark, d, "knn_to_geodesic_graph").where("weight <= 1"), method="louvain")


@query()
def l10_cluster_cells(spark, d):
    from functools import partial

    return graph.cluster_cells(_embeddings(spark, d), graph.exact_neighbours, graph.knn_to_geodesic, partial(graph.communities, method="leiden"))


# -- tables of plots ------------------------------------------------------------------------------


@query(f"""{views('m', 'dims', 'mg')}, {_DENSE}, f AS (SELECT * FROM d WHERE r IN (0, 3, 9)), s AS (SELECT r, avg(v) AS mu, stddev_samp(v) AS sd FROM f GROUP BY r)
SELECT r AS row, cell_group, round(avg((v - mu) / sd), 8) AS mean_z, round(100 * avg((v <> 0)::INT), 8) AS percent FROM f JOIN s USING (r) JOIN mg USING (c) GROUP BY ALL""")
def a19_dot_table(spark, d):
    return plotdata.dot_table(a.counts(spark, d), [0, 3, 9], a.groups(spark, d)).select("row", "cell_group", F.round("mean_z", 8).alias("mean_z"), F.round("percent", 8).alias("percent"))


@query("""WITH r AS (SELECT n_reads AS reads, row_number() OVER (ORDER BY n_reads DESC) AS rank FROM cells WHERE n_reads IS NOT NULL), t AS (SELECT count(*) AS t FROM r),
k AS (SELECT DISTINCT round(exp(k * (ln(greatest(t, 1)) / 199)))::BIGINT AS rank FROM t, range(0, 200) g(k)) SELECT rank, reads, reads >= 1000 AS over_cutoff FROM r JOIN k USING (rank)""")
def a20_knee_points(spark, d):
    return plotdata.knee_points(table(spark, d, "cells"), "n_reads", 200, 1000)


@query(f"""SELECT floor(log10(n_fragments) * (100.0::DOUBLE / 6))::INT AS x_bin, floor(tss_enrichment * 2)::INT AS y_bin, count(*) AS n, count(*) FILTER (n_fragments >= 20 AND tss_enrichment >= 0.5) AS n_pass
 FROM ({SQL["a12_cell_qc"]}) GROUP BY ALL""")
def a21_tss_scatter(spark, d):
    qc = atac.qc_cells(a.frags(spark, d), a.genes(spark, d), a.blacklist(spark, d))
    return plotdata.tss_scatter(qc, 20, 0.5)


@query(f"""{views('frags', 'cg', 'genes', 'sites')}, c AS (SELECT chr, strand, CASE WHEN strand THEN start ELSE "end" - 1 END AS centre FROM genes),
h AS (SELECT cell_group, CASE WHEN strand THEN pos - centre ELSE centre - pos END AS position, count(*)::DOUBLE AS n FROM sites s JOIN cg USING (cell_id) JOIN c ON s.chr = c.chr AND pos >= centre - 2000 AND pos <= centre + 2000 GROUP BY ALL),
g AS (SELECT cell_group, range::INT AS position FROM (SELECT DISTINCT cell_group FROM cg), range(-2000, 2001)), f AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (cell_group, position)),
e AS (SELECT *, n / nullif(avg(n) FILTER (abs(position) > 1900) OVER (PARTITION BY cell_group), 0) AS enrichment FROM f)
SELECT cell_group, position, n, round(enrichment, 8) AS enrichment, round(CASE WHEN count(*) OVER w = 11 THEN avg(enrichment) OVER w END, 8) AS smooth FROM e WINDOW w AS (PARTITION BY cell_group ORDER BY position ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def a22_tss_profile(spark, d):
    cells = a.cell_groups(spark, d).withColumn("weight", F.lit(1.0))
    f = overlap.footprint(a.frags(spark, d), a.genes(spark, d), cells, flank=2000, normalization_width=100)
    out = stats.rolling_mean(f, ["cell_group"], "position", "enrichment", 11, "smooth")
    return out.withColumns({"enrichment": F.round("enrichment", 8), "smooth": F.round("smooth", 8)})


@query()
def l11_smoothed_features(spark, d):
    m = a.counts(spark, d)
    near = F.explode(F.sequence(F.lit(0), F.lit(4)))
    ring = m.cols().select("col", near.alias("k")).select(((F.col("col") + F.col("k")) % m.ncol).alias("row"), "col", F.lit(1.0).alias("val"))
    links = matrix.SparseMatrix.of(ring, m.ncol, m.ncol)
    return plotdata.smoothed_features(m, [0, 3], links)


@query(f"""{views("genes")} SELECT gene_id, greatest(start, 5000000)::INT AS start, least("end", 25000000)::INT AS "end" FROM genes WHERE chr = 'chr2' AND start < 25000000 AND "end" > 5000000""")
def plot_gene_track(spark, d):
    return plotdata.clipped_segments(a.genes(spark, d), "chr2", 5_000_000, 25_000_000).select("gene_id", "start", "end")


@query(f"""{views("genes")}, g AS (SELECT * FROM genes WHERE chr = 'chr2') SELECT x.gene_id, count(*)::INT AS lanes FROM g x JOIN g y ON (y.start < x.start OR (y.start = x.start AND y.gene_id <= x.gene_id)) AND y."end" > x.start GROUP BY 1""")
def plot_lanes(spark, d):
    return plotdata.lanes(a.genes(spark, d).where("chr = 'chr2'"), "gene_id")


@query(f"""{views("genes")}, p AS (SELECT gene_id, strand, unnest(range(start, "end", 10000)) AS pos FROM genes UNION SELECT gene_id, strand, "end" FROM genes),
 n AS (SELECT gene_id, strand, pos, lead(pos) OVER (PARTITION BY gene_id ORDER BY pos) AS nx FROM p)
 SELECT gene_id, (CASE WHEN strand THEN pos ELSE nx END)::INT AS from_pos, (CASE WHEN strand THEN nx ELSE pos END)::INT AS to_pos FROM n WHERE nx IS NOT NULL""")
def plot_arrow_segments(spark, d):
    return plotdata.arrow_segments(a.genes(spark, d), "gene_id", 10_000)


@query(f"""{views("genes")}, h AS (SELECT 0.75::DOUBLE * pi() / 2 AS half), g AS (SELECT gene_id, start, "end" AS e, k::INT AS step, (k / 100.0::DOUBLE * 2 - 1) * half AS angle, half FROM genes, h, range(0, 101) t(k)
 WHERE chr = 'chr2' AND start < 25000000 AND "end" > 5000000 AND NOT (start <= 5000000 AND "end" >= 25000000))
 SELECT gene_id, step, round((start + e) / 2 + (e - start) / 2 * sin(angle) / sin(half), 2) + 0 AS x, round(-(cos(angle) - cos(half)) / (1 - cos(half)) * (e - start), 2) + 0 AS y FROM g""")
def plot_loop_arcs(spark, d):
    arcs = plotdata.loop_arcs(a.genes(spark, d), "gene_id", "chr2", 5_000_000, 25_000_000)
    return arcs.select("gene_id", "step", (F.round("x", 2) + 0).alias("x"), (F.round("y", 2) + 0).alias("y"))


@query(f"{views('frags', 'sites')} SELECT chr, (pos // 100000)::INT AS tile, cell_id, count(*) AS n FROM sites GROUP BY ALL")
def stream_tile_counts(spark, d):
    """The streaming aggregation applied to the whole table at once."""
    return stream_tiles.tile_counts(a.frags(spark, d), 100_000)


def _transcripts(spark, d, choice):
    g = valid_records(load_records(table(spark, d, "gtf"), "gtf"))
    return transcripts(g, choice, ".*").select("chr", "feature", "start", "end", "gene_id", "transcript_id")


def _attribute(name):
    return f"""nullif(regexp_extract(attributes, '(?:^|; ?){name} "([^"]*)"', 1), '')"""


_TRANSCRIPTS = f"""SELECT chr, feature, (start - 1)::INT AS start, "end", {_attribute("gene_id")} AS gene_id, {_attribute("transcript_id")} AS transcript_id
 FROM ({records.SQL["p1_gtf_records"]}) WHERE feature IN ('transcript', 'exon') AND {_attribute("gene_type")} IS NOT NULL"""


@query(_TRANSCRIPTS)
def s17_transcripts(spark, d):
    return _transcripts(spark, d, "all")


@query(f"{_TRANSCRIPTS} AND contains(attributes, 'tag \"Ensembl_Canonical\"')")
def s17_canonical_transcripts(spark, d):
    return _transcripts(spark, d, "Ensembl_Canonical")


@query(f"""{views('m', 'dims')}, x0 AS (SELECT c, r, v FROM m WHERE r IN (0, 3)), k AS (SELECT range AS k FROM range(0, 5)),
x1 AS (SELECT (c - k + nc) % nc AS c, r, sum(v / 5) AS v FROM x0, k, dims GROUP BY ALL), x2 AS (SELECT (c - k + nc) % nc AS c, r, sum(v / 5) AS v FROM x1, k, dims GROUP BY ALL),
x3 AS (SELECT (c - k + nc) % nc AS c, r, sum(v / 5) AS v FROM x2, k, dims GROUP BY ALL),
f AS (SELECT g.c, t.r, coalesce(v, 0) * (SELECT sum(v) FROM x0 WHERE x0.r = t.r) / (SELECT sum(v) FROM x3 WHERE x3.r = t.r) AS v FROM (SELECT range AS c FROM dims, range(0, nc)) g CROSS JOIN (VALUES (0), (3)) t(r) LEFT JOIN x3 ON x3.c = g.c AND x3.r = t.r),
q AS (SELECT r, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM f GROUP BY r)
SELECT c AS col, f.r::BIGINT AS row, round(least(greatest(v, lo), hi), 7) AS value FROM f JOIN q ON f.r = q.r""")
def l11_smoothed_values(spark, d):
    return l11_smoothed_features(spark, d).withColumn("value", F.round("value", 7))


@query(SQL["l2_knn_euclidean"])
def l2_knn_lists(spark, d):
    """Inverted lists with all of them probed: exact."""
    return graph.approximate_neighbours(_embeddings(spark, d), lists=4, probes=4).withColumn("dist", F.round("dist", 5))


@query(f"WITH {_KNN.format(m='list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2])))')} SELECT i, nn_rank::INT AS nn_rank, idx, round(dist, 5) AS dist FROM k WHERE nn_rank <= 10")
def l2_knn_manhattan(spark, d):
    return graph.exact_neighbours(_embeddings(spark, d), metric="manhattan").withColumn("dist", F.round("dist", 5))
