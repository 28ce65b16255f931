"""Queries of the problems on vectors, graphs and texts over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .clusters import density_clusters, describe_clusters
from .encode import encode_corpus
from .leaks import leaked_items, leaked_passages
from .split import split_oversized
from .vectors import nearest_vectors, neighbour_pairs

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(table(spark, d, "cell_vectors")))


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    return nearest_vectors(table(spark, d, "cell_vectors"), queries=F.col("id") % 20 == 0).withColumn("dist", F.round("dist", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return density_clusters(table(spark, d, "knn_to_geodesic_graph")).select(F.col("id").alias("vec_id"), "cluster_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(density_clusters(table(spark, d, "knn_to_geodesic_graph")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Matches of at least 12 words with at most two words missing or changed between two."""
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), slop=2)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents")).where("piece_no = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_knn, p3_found, p3_clusters, p6_ids, p7_found, p7_proximity, p8_found, p8_pieces)}

_NEAREST = """WITH ok AS (SELECT vec_id, min(vec)::DOUBLE[] AS vec FROM cell_vectors
 WHERE vec IS NOT NULL AND vec_id IS NOT NULL AND len(vec) = 32 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY vec_id),
k AS (SELECT a.vec_id AS i, b.vec_id AS idx, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS nn_rank
 FROM ok a JOIN ok b ON a.vec_id <> b.vec_id {w})"""

# brute force, as far as the test sizes allow it
SQL: dict[str, str] = {
    "p2_found": f"{_NEAREST.format(w='')} SELECT DISTINCT least(i, idx) AS vec_a, greatest(i, idx) AS vec_b FROM k WHERE nn_rank <= 10",
    "p2_knn": f"{_NEAREST.format(w='WHERE a.vec_id % 20 = 0')} SELECT i, nn_rank::INT AS nn_rank, idx, round(dist, 6) AS dist FROM k WHERE nn_rank <= 10",
}
