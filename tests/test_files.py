import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators.matrix import SparseMatrix
from strandloom.sources import files
from strandloom.streaming import tiles

FRAGS = "chr string, start int, end int, cell_id string"


def test_fragment_files(spark, tmp_path):
    text = "# a comment\nchr1\t10\t20\tA\t1\nchr1\t15\t30\tB\t2\nchr2\t5\t9\tA\t1\n"
    with gzip.open(tmp_path / "f.tsv.gz", "wt") as out:
        out.write(text)
    df = files.read_fragments_tsv(spark, str(tmp_path / "f.tsv.gz"))
    rows = [("chr1", 10, 21, "A"), ("chr1", 15, 31, "B"), ("chr2", 5, 10, "A")]
    assert sorted(map(tuple, df.collect())) == rows
    files.write_fragments_tsv(df, str(tmp_path / "back"), fifth_column=True)
    assert sorted(map(tuple, files.read_fragments_tsv(spark, str(tmp_path / "back")).collect())) == rows
    files.import_fragments(spark, str(tmp_path / "f.tsv.gz"), str(tmp_path / "kept"), 4, -5, df.where("cell_id = 'B'"))
    assert [(r.start, r.end, r.cell_id) for r in files.read_fragments(spark, str(tmp_path / "kept")).collect()] == [(19, 26, "B")]
    assert sorted(map(tuple, files.fragments_of(df.withColumn("x", F.lit(1)), zero_based=False).collect()))[0] == ("chr1", 9, 21, "A")
    files.write_fragments(df, str(tmp_path / "dir"))
    again = files.read_fragments(spark, str(tmp_path / "dir")).select("chr", "start", "end", "cell_id")
    assert sorted(map(tuple, again.collect())) == rows
    files.replace_fragments(again.where("chr = 'chr1'"), str(tmp_path / "dir"))  # reads what it replaces
    assert files.read_fragments(spark, str(tmp_path / "dir")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.write_fragments(df, str(tmp_path / "dir"))


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#!x\nchr1\ts\tgene\t11\t20\t.\t-\t.\tgene_id "G1"; gene_type "lncRNA"; tag "basic";\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "G1";\n')
    r = files.read_gtf(spark, str(tmp_path / "a.gtf"), tags=("basic", "other")).collect()
    assert [(x.chr, x.start, x.end, x.strand, x.gene_id, x.basic, x.other) for x in r] == [("chr1", 10, 20, False, "G1", True, False)]
    assert files.read_gtf(spark, str(tmp_path / "a.gtf"), gene_type="lnc").count() == 0
    (tmp_path / "s.txt").write_text("chr1\t100\nchrUn_1\t5\nchrX\t7\n")
    assert sorted((x.chr, x.start, x.end) for x in files.read_chrom_sizes(spark, str(tmp_path / "s.txt")).collect()) == [("chr1", 0, 100), ("chrX", 0, 7)]
    (tmp_path / "b.bed").write_text("chr1\t1\t2\tHigh signal\n")
    assert files.read_bed(spark, str(tmp_path / "b.bed"), "reason string").first().reason == "High signal"
    (tmp_path / "n.narrowPeak").write_text("chr1\t1\t9\tp\t5\t.\t1.5\t2.5\t3.5\t4\n")
    assert files.read_narrow_peaks(spark, str(tmp_path / "n.narrowPeak"), "g").first().summit == 4


def test_matrix_files(spark, tmp_path):
    body = "%%MatrixMarket matrix coordinate real general\n% note\n\n4 5 3\n1 1 2.5\n4 5 -1\n2 3 7\n"
    (tmp_path / "matrix.mtx").write_text(body)
    (tmp_path / "features.tsv").write_text("i1\tn1\tGene\ni2\tn2\tPeak\ni3\tn3\tGene\ni4\tn4\tPeak\n")
    (tmp_path / "barcodes.tsv").write_text("a\nb\nc\nd\ne\n")
    m = files.read_matrix_market(spark, str(tmp_path / "matrix.mtx"))
    assert (m.nrow, m.ncol) == (4, 5) and {tuple(r) for r in m.entries.collect()} == {(0, 0, 2.5), (3, 4, -1.0), (1, 2, 7.0)}
    m2, f, b = files.read_matrix_10x(spark, str(tmp_path), "Peak")
    assert (m2.nrow, m2.ncol) == (2, 5) and {tuple(r) for r in m2.entries.collect()} == {(1, 4, -1.0), (0, 2, 7.0)}
    assert [r.feature_id for r in f.orderBy("row").collect()] == ["i2", "i4"] and b.count() == 5
    files.write_matrix(m, str(tmp_path / "m"))
    back = files.read_matrix(spark, str(tmp_path / "m"))
    assert (back.nrow, back.ncol) == (4, 5) and {tuple(r) for r in back.entries.collect()} == {tuple(r) for r in m.entries.collect()}
    turned = files.transpose_storage(m, str(tmp_path / "t"))
    assert {tuple(r) for r in turned.entries.collect()} == {tuple(r) for r in m.entries.collect()}
    files.write_dense(m, str(tmp_path / "dense"))
    assert [r.vals for r in spark.read.parquet(str(tmp_path / "dense")).orderBy("row").collect()][1] == [0, 0, 7.0, 0, 0]
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n2\n")
    with pytest.raises(ValueError):
        files.read_matrix_market(spark, str(tmp_path / "bad.mtx"))


def test_stream_equals_table(spark, tmp_path):
    rows = [("chr1", 10 * k, 10 * k + 25, f"c{k % 3}") for k in range(60)] + [(None, 1, 2, "x"), ("chr1", 5, 5, "x")]
    df = spark.createDataFrame(rows, FRAGS).withColumn("loaded_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("end")))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = tiles.fragment_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = tiles.start(tiles.tile_counts(stream, 100), "tiles_now", str(tmp_path / "state"), "complete")
    q.processAllAvailable()
    got = {tuple(r) for r in spark.table("tiles_now").collect()}
    q.stop()
    assert got == {tuple(r) for r in tiles.tile_counts(df, 100).collect()}
    q = tiles.start(tiles.windowed_counts(stream, "1 minute", "1 minute"), "windows", str(tmp_path / "state2"), "update")
    q.processAllAvailable()
    assert spark.table("windows").count() > 0
    q.stop()
    q = tiles.start_files(tiles.windowed_counts(stream, "1 minute", "1 minute"), str(tmp_path / "out"), str(tmp_path / "state3"))
    q.processAllAvailable()
    q.stop()
    whole = {(r.from_time, r.chr): r.n for r in tiles.windowed_counts(df, "1 minute", "1 minute").collect()}
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert done and all(0 < r.n <= whole[r.from_time, r.chr] for r in done)


def test_grouped_output(spark, tmp_path):
    df = spark.createDataFrame([("g1", "chr1", 1, 2), ("g2", "chr1", 5, 6), ("g1", "chr1", 0, 1)], "cell_group string, chr string, start int, end int")
    files.write_grouped_bed(df, str(tmp_path / "bed"))
    assert sorted(p.name for p in (tmp_path / "bed").iterdir() if p.is_dir()) == ["cell_group=g1", "cell_group=g2"]
    assert np.sum([len(p.read_text().splitlines()) for p in (tmp_path / "bed").rglob("*.csv")]) == 3
    files.write_bedgraph(df.withColumn("score", F.col("end") / 3), str(tmp_path / "graph"))
    text = [line for p in (tmp_path / "graph" / "cell_group=g1").glob("*.csv") for line in p.read_text().splitlines()]
    assert text == ["chr1\t0\t1\t0.3333", "chr1\t1\t2\t0.6667"]
    assert isinstance(SparseMatrix.of(df, 1, 1, "start", "end", "start"), SparseMatrix)
