"""Edge multiplicities that grow with a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from strandwork.operators import kmers


def count_edges(reads: DataFrame, k1: int) -> DataFrame:
    """Edges of a streaming frame of reads. Counts only add up, so update mode is exact; what follows (coverage, contraction) is not monotone and belongs in foreachBatch."""
    return kmers.edges(reads, k1)


def to_memory(edges: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return edges.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def to_folder(edges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed edges in a subfolder of its number, which a repeated batch writes anew: nothing passes through the driver."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return edges.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of such a folder with their last multiplicities."""
    rows = spark.read.parquet(folder)
    keys = [c for c in rows.columns if c not in ("multiplicity", "batch")]
    return rows.groupBy(*keys).agg(F.max_by("multiplicity", "batch").alias("multiplicity"))
