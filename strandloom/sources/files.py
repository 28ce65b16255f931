"""Text and directory formats of fragments, ranges, annotations and matrices.

Readers are lazy scans with given schemas; malformed lines follow Spark's permissive text mode
unless they are loaded by ``raw_records``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.matrix import SparseMatrix
from ..operators.ranges import checked_broadcast


def read_fragments_tsv(spark: SparkSession, path: str, end_inclusive: bool = True, comment: str = "#") -> DataFrame:
    """``chr, start, end, cell_id`` of a (compressed) fragment table; an inclusive end gets 1 added."""
    df = spark.read.csv(path, sep="\t", comment=comment, schema="chr string, start int, end int, cell_id string, pcr_duplicates int")
    return df.select("chr", "start", (F.col("end") + int(end_inclusive)).alias("end"), "cell_id")


def write_fragments_tsv(df: DataFrame, path: str, end_inclusive: bool = True, fifth_column: bool = False) -> None:
    """Files sorted by (chr, start), compressed; ranges of files follow each other."""
    out = df.select("chr", "start", (F.col("end") - int(end_inclusive)).alias("end"), "cell_id", *([F.lit(0).alias("n")] if fifth_column else []))
    out.orderBy("chr", "start").write.mode("errorifexists").csv(path, sep="\t", compression="gzip")


def write_fragments(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Columnar, by chromosome and sorted by start, so that scans prune both."""
    df.repartition("chr").sortWithinPartitions("chr", "start").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chr").parquet(path)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_fragments(df: DataFrame, path: str) -> None:
    """Overwrite a directory that ``df`` itself may read: written beside it, then renamed."""
    spark = df.sparkSession
    write_fragments(df, f"{path}.new", overwrite=True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    fs.delete(old, True)
    # at every moment one whole copy is there, under one of the three names
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not rename {path}")
    if not fs.rename(new, at):
        raise OSError(f"could not rename {path}.new")
    fs.delete(old, True)


def import_fragments(spark: SparkSession, path: str, out: str, shift_start: int = 0, shift_end: int = 0, keep_cells: DataFrame | None = None) -> None:
    """A fragment table into a fragment directory, shifted, and with a list only of its cells."""
    from ..operators.fragments import select_cells, shift

    df = shift(read_fragments_tsv(spark, path), shift_start, shift_end)
    write_fragments(df if keep_cells is None else select_cells(df, keep_cells), out)


def fragments_of(df: DataFrame, zero_based: bool = True) -> DataFrame:
    """Any table with ``chr, start, end, cell_id`` as fragments; 1-based starts get 1 taken off."""
    return df.select(F.col("chr").cast("string").alias("chr"), (F.col("start").cast("int") - int(not zero_based)).alias("start"), F.col("end").cast("int").alias("end"), F.col("cell_id").cast("string").alias("cell_id"))


def read_bed(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """``chr, start, end`` and further columns by a schema text; comment lines are skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chr string, start int, end int" + (", " + extra if extra else ""))


def read_chrom_sizes(spark: SparkSession, path: str, keep: str = "chr[0-9]+|chrX|chrY") -> DataFrame:
    """``chr, start, end`` of chromosomes whose whole name matches ``keep``."""
    return whole_chromosomes(spark.read.csv(path, sep="\t", schema="chr string, chr_size int"), keep)


def whole_chromosomes(sizes: DataFrame, keep: str = "chr[0-9]+|chrX|chrY") -> DataFrame:
    """``chr, start, end`` from ``chr, chr_size``."""
    return sizes.where(F.col("chr").rlike(f"^({keep})$")).select("chr", F.lit(0).alias("start"), F.col("chr_size").alias("end"))


def attribute(column: Column, name: str) -> Column:
    """The quoted value of an attribute, or null."""
    found = F.regexp_extract(column, rf'(?:^|; ?){name} "([^"]*)"', 1)
    return F.when(found != "", found)


def gtf_features(records: DataFrame, features: tuple[str, ...] = ("gene",), attributes: tuple[str, ...] = ("gene_id",), tags: tuple[str, ...] = (), gene_type: str | None = None) -> DataFrame:
    """Features of loaded annotation records as 0-based ranges with the named attributes and a
    boolean per tag."""
    df = records.where(F.col("feature").isin(*features))
    if gene_type is not None:
        df = df.where(attribute(F.col("attributes"), "gene_type").rlike(f"^({gene_type})$"))
    cols = [attribute(F.col("attributes"), a).alias(a) for a in attributes]
    flags = [F.col("attributes").contains(f'tag "{t}"').alias(t) for t in tags]
    return df.select("chr", "source", "feature", (F.col("start") - 1).alias("start"), "end", "score", (F.col("strand") != "-").alias("strand"), "frame", *cols, *flags)


def read_gtf(spark: SparkSession, path: str, **kw) -> DataFrame:
    schema = "chr string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"
    return gtf_features(spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="\0"), **kw)


def transcripts(records: DataFrame, choice: str = "MANE_Select", gene_type: str = "lncRNA|protein_coding|IG_.*_gene|TR_.*_gene", features: tuple[str, ...] = ("transcript", "exon")) -> DataFrame:
    """Transcripts and exons with their gene and transcript ids; ``choice`` is the tag of the
    representative ones (``MANE_Select`` or ``Ensembl_Canonical``), or ``all``."""
    if choice not in ("MANE_Select", "Ensembl_Canonical", "all"):
        raise ValueError("the choice must be MANE_Select, Ensembl_Canonical or all")
    tags = () if choice == "all" else (choice,)
    out = gtf_features(records, features, ("gene_id", "gene_type", "gene_name", "transcript_id"), tags, gene_type)
    return out if choice == "all" else out.where(F.col(choice))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, as the executors' file system sees it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_narrow_peaks(spark: SparkSession, path: str, group: str) -> DataFrame:
    schema = "chr string, start int, end int, name string, score int, strand string, signal double, p_val double, q_val double, summit int"
    return spark.read.csv(path, sep="\t", schema=schema).withColumn("cell_group", F.lit(group))


def read_matrix_market(spark: SparkSession, path: str) -> SparseMatrix:
    """A general coordinate matrix of integers, reals or a pattern, with 1-based indexes."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    head = lines.where(F.col("value").startswith("%%MatrixMarket")).limit(1).collect()
    words = head[0][0].lower().split() if head else []
    if words[1:3] != ["matrix", "coordinate"] or words[3] not in ("integer", "real", "pattern") or words[4] != "general":
        raise ValueError("only general coordinate matrices of integers, reals or patterns are read")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = body.orderBy("at").limit(1).collect()[0]
    nrow, ncol, _ = map(int, first["value"].split())
    parts = F.split(F.trim("value"), r"\s+")
    val = F.lit(1.0) if words[3] == "pattern" else F.get(parts, F.lit(2)).cast("double")
    e = body.where(F.col("at") != first["at"]).select((F.get(parts, F.lit(0)).cast("bigint") - 1).alias("row"), (F.get(parts, F.lit(1)).cast("bigint") - 1).alias("col"), val.alias("val"))
    return SparseMatrix.of(e, nrow, ncol)


def read_matrix_10x(spark: SparkSession, folder: str, feature_type: str | None = None) -> tuple[SparseMatrix, DataFrame, DataFrame]:
    """The matrix, its features (``row, feature_id, name, feature_type``) and barcodes (``col,
    barcode``); with a feature type only rows of it, renumbered."""
    m = read_matrix_market(spark, f"{folder}/matrix.mtx.gz" if _exists(spark, f"{folder}/matrix.mtx.gz") else f"{folder}/matrix.mtx")
    f = _numbered(spark, folder, "features.tsv").select(F.col("at").alias("row"), *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(("feature_id", "name", "feature_type"))])
    b = _numbered(spark, folder, "barcodes.tsv").select(F.col("at").alias("col"), F.col("value").alias("barcode"))
    if feature_type is not None:
        kept = f.where(F.col("feature_type") == feature_type).withColumn("new", F.row_number().over(Window.orderBy("row")) - 1)  # one row a feature
        e = m.entries.join(checked_broadcast(kept.select("row", "new")), "row").select(F.col("new").cast("bigint").alias("row"), "col", "val")
        m, f = SparseMatrix(e, kept.count(), m.ncol), kept.withColumn("row", F.col("new").cast("bigint")).drop("new")
    return m, f, b


def _numbered(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.gz" if _exists(spark, f"{folder}/{name}.gz") else f"{folder}/{name}"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "(\r?\n)+$", ""), "\r?\n")).alias("at", "value"))
    return lines.select(F.col("at").cast("bigint").alias("at"), "value", F.split("value", "\t").alias("p"))


def write_matrix(m: SparseMatrix, path: str, overwrite: bool = False, by: str = "col") -> None:
    """Entries sorted by column and row (or row and column): the storage order of the directory."""
    other = "row" if by == "col" else "col"
    m._plain("writing")
    m.entries.repartitionByRange(by).sortWithinPartitions(by, other).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/entries")
    m.entries.sparkSession.createDataFrame([(json.dumps({"nrow": m.nrow, "ncol": m.ncol, "order": by}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_matrix(spark: SparkSession, path: str) -> SparseMatrix:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return SparseMatrix(spark.read.parquet(f"{path}/entries"), meta["nrow"], meta["ncol"])


def write_dense(m: SparseMatrix, path: str) -> None:
    """All elements, one row of the matrix a record (``row, vals``): for matrices of modest size."""
    w = F.sort_array(F.collect_list(F.struct("col", "val")))
    m.densify().groupBy("row").agg(F.transform(w, lambda x: x["val"]).alias("vals")).write.mode("errorifexists").parquet(path)


def transpose_storage(m: SparseMatrix, path: str, by: str = "row") -> SparseMatrix:
    """The matrix written in the other storage order and opened again."""
    write_matrix(m, path, by=by)
    return read_matrix(m.entries.sparkSession, path)


def write_grouped_bed(df: DataFrame, path: str) -> None:
    """Rows with a ``cell_group`` as sorted text files, one folder a group."""
    df.repartition("cell_group").sortWithinPartitions("cell_group", "chr", "start").write.mode("errorifexists").partitionBy("cell_group").csv(path, sep="\t")


def write_bedgraph(df: DataFrame, path: str) -> None:
    """``cell_group, chr, start, end, score`` as text files by group, scores with four digits."""
    write_grouped_bed(df.select("cell_group", "chr", "start", "end", F.format_string("%.4f", F.col("score").cast("double")).alias("score")), path)
