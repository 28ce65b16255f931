"""Cut sites per tile and cell, kept up to date while fragment files arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fragments import insertions

SCHEMA = "chr string, start int, end int, cell_id string, loaded_at timestamp"


def fragment_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tile_counts(frags: DataFrame, tile_width: int) -> DataFrame:
    """``chr, tile, cell_id, n`` for a stream or a table alike; incomplete fragments don't count."""
    whole = frags.where("chr is not null and start is not null and end > start and cell_id is not null")
    tile = F.floor(F.col("pos") / tile_width).cast("int")
    return insertions(whole).groupBy("chr", tile.alias("tile"), "cell_id").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(frags: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``from_time, chr, n`` per event-time window; rows later than the watermark are left out."""
    w = F.window("loaded_at", window)
    counted = frags.withWatermark("loaded_at", late).groupBy(w, "chr").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("from_time"), "chr", "n")


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows appended to Parquet files, each once also after a restart."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
