"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``.  Where it is unset, a local master gets a
    folder of its own; on a cluster that folder would not be shared, so this raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandloom-")
    sc.setCheckpointDir(folder)


def drop_folder(spark: SparkSession, folder: str | None) -> None:
    """Delete a checkpoint that later ones have replaced."""
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there.

    A checkpointed plan keeps the size and the constraints estimated for its origin; over the
    rounds of a loop these estimates grow beyond measure.  So the stored rows are given a plan that
    knows their schema only; adaptive execution then sees their true sizes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    stored = df.checkpoint(eager=True)._jdf
    rows = stored.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, stored.schema(), False), spark)
