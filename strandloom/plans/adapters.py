"""The domain's relations as views of the test tables, for Spark and as SQL text.

Fragments, cells and chromosome sizes are tables of their own; peaks, genes, a blacklist and a
sparse matrix are derived from the keys of the other tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from ..session import table


def frags(spark: SparkSession, d: str) -> DataFrame:
    """Complete fragments, each once; a cell is named by sample and barcode."""
    t = table(spark, d, "fragments")
    cell = F.concat_ws("#", "sample_id", "cell_id").alias("cell_id")
    whole = t.where('chr is not null and start >= 0 and `end` > start and cell_id is not null and sample_id is not null')
    return whole.select("frag_id", "chr", "start", "end", cell).distinct()


def cell_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cells").where("cell_id is not null and sample_id is not null")
    return t.groupBy(F.concat_ws("#", "sample_id", "cell_id").alias("cell_id")).agg(F.min(F.coalesce("cell_type", F.lit("none"))).alias("cell_group"))


def _place(key: str, factor: int) -> tuple[Column, Column]:
    k = F.col(key)
    return F.concat(F.lit("chr"), (1 + k % 20).cast("string")).alias("chr"), ((k * factor) % 60_000_000).cast("int")


def peaks(spark: SparkSession, d: str) -> DataFrame:
    c, start = _place("o_orderkey", 173_003)
    width = (5000 + F.col("o_custkey") % 3000).cast("int")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("peak_id"), c, start.alias("start"), (start + width).alias("end"), (F.col("o_orderkey") % 2 == 0).alias("strand"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    c, start = _place("p_partkey", 1_291_003)
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), name.alias("gene_name"), c, start.alias("start"), (start + 2000 * F.col("p_size")).cast("int").alias("end"), (F.col("p_partkey") % 2 == 0).alias("strand"))


def blacklist(spark: SparkSession, d: str) -> DataFrame:
    c, start = _place("s_suppkey", 911_003)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), c, start.alias("start"), (start + 50_000).alias("end"))


def chrom_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chrom_sizes").select("chr", F.col("chr_size").cast("int").alias("chr_size"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Two regions that touch per chromosome."""
    half = F.floor(F.col("chr_size") / 2).cast("int")
    cut = F.array(F.struct(F.lit("a").alias("s"), F.lit(0).alias("start"), half.alias("end")), F.struct(F.lit("b").alias("s"), half.alias("start"), F.col("chr_size").alias("end")))
    t = chrom_sizes(spark, d).select("chr", F.inline(cut))
    return t.select(F.concat_ws(":", "chr", "s").alias("region_id"), "chr", "start", "end", F.lit(1_000_000).alias("tile_width"))


def counts(spark: SparkSession, d: str) -> SparseMatrix:
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("val"))
    return SparseMatrix.of(e, table(spark, d, "part").count(), table(spark, d, "supplier").count())


def groups(spark: SparkSession, d: str) -> DataFrame:
    """The columns of ``counts`` in groups."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("idx"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("cell_group"))  # 25 nations


def row_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("v"))


def col_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.col("s_nationkey") + 1).cast("double").alias("v"))


def _place_sql(key: str, factor: int) -> str:
    return f"'chr' || (1 + {key} % 20) AS chr, (({key} * {factor}) % 60000000)::INT AS start"


VIEWS: dict[str, str] = {
    "frags": """frags AS (SELECT DISTINCT frag_id, chr, start, "end", sample_id || '#' || cell_id AS cell_id FROM fragments
 WHERE chr IS NOT NULL AND start >= 0 AND "end" > start AND cell_id IS NOT NULL AND sample_id IS NOT NULL)""",
    "cg": """cg AS (SELECT sample_id || '#' || cell_id AS cell_id, min(coalesce(cell_type, 'none')) AS cell_group FROM cells
 WHERE sample_id IS NOT NULL AND cell_id IS NOT NULL GROUP BY 1)""",
    "peaks": f'peaks AS (SELECT o_orderkey AS peak_id, {_place_sql("o_orderkey", 173003)}, (start + 5000 + o_custkey % 3000)::INT AS "end", o_orderkey % 2 = 0 AS strand FROM orders)',
    "genes": f'genes AS (SELECT p_partkey AS gene_id, p_name || p_partkey AS gene_name, {_place_sql("p_partkey", 1291003)}, (start + 2000 * p_size)::INT AS "end", p_partkey % 2 = 0 AS strand FROM part)',
    "bl": f'bl AS (SELECT s_suppkey AS id, {_place_sql("s_suppkey", 911003)}, (start + 50000)::INT AS "end" FROM supplier)',
    "sizes": "sizes AS (SELECT chr, chr_size::INT AS chr_size FROM chrom_sizes)",
    "regions": """regions AS (SELECT chr || ':a' AS region_id, chr, 0 AS start, (chr_size // 2)::INT AS "end" FROM chrom_sizes
 UNION ALL SELECT chr || ':b', chr, (chr_size // 2)::INT, chr_size::INT FROM chrom_sizes)""",
    "m": "m AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "dims": "dims AS (SELECT (SELECT count(*) FROM part) AS nr, (SELECT count(*) FROM supplier) AS nc)",
    "mg": "mg AS (SELECT s_suppkey AS c, 'g' || n_regionkey AS cell_group FROM supplier JOIN nation ON s_nationkey = n_nationkey)",
    "rv": "rv AS (SELECT p_partkey AS r, p_size::DOUBLE AS x FROM part)",
    "cv": "cv AS (SELECT s_suppkey AS c, (s_nationkey + 1)::DOUBLE AS x FROM supplier)",
    "sites": 'sites AS (SELECT frag_id, cell_id, chr, start AS pos, true AS is_start, start AS f_start FROM frags UNION ALL SELECT frag_id, cell_id, chr, "end" - 1, false, start FROM frags)',
}


def views(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ",\n".join(VIEWS[n] for n in names)
