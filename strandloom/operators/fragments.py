"""Selections, projections and summaries of fragments (``chr, start, end, cell_id``).

All are lazy projections, filters or joins of DataFrames; nothing depends on the order of rows.
Nulls follow SQL: a row whose tested column is null is not selected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import checked_broadcast


def shift(df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    return df.withColumns({"start": F.col("start") + start, "end": F.col("end") + end})


def subset_lengths(df: DataFrame, min_len: int = 0, max_len: int | None = None) -> DataFrame:
    """Lengths of ``min_len`` to ``max_len``, both included."""
    size = F.col("end").cast("bigint") - F.col("start")
    out = df.where(size >= min_len)
    return out if max_len is None else out.where(size <= max_len)


def select_chromosomes(df: DataFrame, names: list[str]) -> DataFrame:
    """Fragments of the named chromosomes with ``chr_id``, the place of the name (from 0)."""
    if len(set(names)) != len(names):
        raise ValueError("names must be distinct")
    return df.where(F.col("chr").isin(names)).withColumn("chr_id", (F.array_position(F.array(*map(F.lit, names)), F.col("chr")) - 1).cast("int"))


def picked(names: list[str], chosen: list[int] | list[bool]) -> list[str]:
    """The names at indexes (from 0; negative ones count from the end) or where a mask holds."""
    if chosen and all(isinstance(k, bool) for k in chosen):
        if len(chosen) != len(names):
            raise ValueError("a mask must be as long as the names")
        return [n for n, k in zip(names, chosen) if k]
    if len({k % len(names) for k in chosen}) != len(chosen) or any(not -len(names) <= k < len(names) for k in chosen):
        raise ValueError("indexes must be distinct and within the names")
    return [names[k] for k in chosen]


def select_chromosomes_at(df: DataFrame, chosen: list[int] | list[bool]) -> DataFrame:
    """Chromosomes by index or mask over their sorted names (one row each, a few hundred)."""
    return select_chromosomes(df, picked(sorted(r[0] for r in df.where("chr is not null").select("chr").distinct().collect()), chosen))


def select_cells_at(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells by index (``idx``, from 0) over their sorted names."""
    names = df.where("cell_id is not null").select("cell_id").distinct()
    counted = names.rdd.map(lambda r: r[0]).sortBy(lambda x: x).zipWithIndex().toDF("cell_id string, idx bigint")
    return select_cells(df, counted.join(checked_broadcast(chosen.select("idx").distinct()), "idx", "left_semi"))


def select_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Fragments of the cells (distinct ``cell_id``) of another table."""
    return df.join(checked_broadcast(cells.select("cell_id").distinct()), "cell_id", "left_semi")


def merge_cells(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``cell_id`` replaced by the cell's group (``cell_id, cell_group``); cells of none are left out."""
    g = groups.select("cell_id", "cell_group").distinct()
    return df.join(checked_broadcast(g), "cell_id").drop("cell_id").withColumnRenamed("cell_group", "cell_id")


def prefix_cells(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("cell_id", F.concat(F.lit(prefix), F.col("cell_id")))


def rename(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``column`` renamed by ``old, new``; other names stay."""
    n = checked_broadcast(names.select(F.col("old").alias("__o"), F.col("new").alias("__n")))
    return df.join(n, F.col(column) == F.col("__o"), "left").withColumn(column, F.coalesce("__n", column)).drop("__o", "__n")


def merge_fragments(parts: list[DataFrame]) -> DataFrame:
    """All fragments of several tables; cell names that clash get the table's number as prefix."""
    tagged = [p.withColumn("__src", F.lit(k)) for k, p in enumerate(parts, 1)]
    both = reduce(DataFrame.unionByName, tagged)
    clash = both.select("cell_id", "__src").distinct().groupBy("cell_id").count().where("count > 1").select(F.col("cell_id").alias("__c"))
    out = both.join(clash, F.col("cell_id") == F.col("__c"), "left")
    return out.withColumn("cell_id", F.when(F.col("__c").isNotNull(), F.concat_ws("_", F.col("__src").cast("string"), "cell_id")).otherwise(F.col("cell_id"))).drop("__c", "__src")


def scan(df: DataFrame) -> DataFrame:
    """One row: fragments, sums of the coordinates, cells and chromosomes."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("bigint")).alias("sum_start"), F.sum(F.col("end").cast("bigint")).alias("sum_end"),
        F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("chr").alias("n_chr"),
    )


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``identical``: whether both hold the same rows the same number of times."""
    cols = a.columns
    n = a.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(1)).unionByName(b.select(cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(-1)))
    odd = n.groupBy(*cols).agg(F.sum(F.col("n") * F.col("s")).alias("d")).where("d <> 0")
    return odd.agg((F.count(F.lit(1)) == 0).alias("identical"))


def insertions(df: DataFrame, mode: str = "both") -> DataFrame:
    """The cut sites of each fragment, start and end - 1, as ``pos`` and ``is_start``."""
    ends: dict[str, list[Column]] = {"start_only": [_site("start", 0, True)], "end_only": [_site("end", -1, False)]}
    sites = ends["start_only"] + ends["end_only"] if mode == "both" else ends[mode]
    return df.select("*", F.inline(F.array(*sites)))


def _site(column: str, by: int, is_start: bool) -> Column:
    return F.struct((F.col(column) + by).alias("pos"), F.lit(is_start).alias("is_start"))


def nucleosome_counts(df: DataFrame, width: int = 147) -> DataFrame:
    """Per cell the fragments of no, one and several nucleosomes, by length div ``width``."""
    k = F.floor((F.col("end") - F.col("start")) / F.lit(width))
    return df.groupBy("cell_id").agg(
        F.count_if(k == 0).alias("sub_nucleosomal"), F.count_if(k == 1).alias("mono_nucleosomal"), F.count_if(k >= 2).alias("multi_nucleosomal"), F.count(F.lit(1)).alias("n_fragments")
    )


def length_histogram(df: DataFrame, max_length: int = 500) -> DataFrame:
    """``length, n, proportion`` of fragments up to ``max_length``; the proportion is of all."""
    counts = df.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.where(F.col("length") <= max_length).crossJoin(F.broadcast(total)).select("length", "n", (F.col("n") / F.col("t")).alias("proportion"))
