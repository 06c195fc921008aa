"""Reads, vertices and results in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import digraph


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """reads(group_key, read_id, seq) of text files: one read a line, all one group."""
    return spark.read.text(path).select(F.lit(0).cast("long").alias("group_key"), F.monotonically_increasing_id().alias("read_id"), F.col("value").alias("seq"))


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_vertex_text(spark: SparkSession, path: str, multi: bool = True) -> DataFrame:
    """Vertices in text form as id, to, from, payload."""
    return digraph.parse_vertex_text(spark.read.text(path), multi)


def from_list(spark: SparkSession, reads: list[str]) -> DataFrame:
    """reads of a list, all one group."""
    return spark.createDataFrame([(0, i, s) for i, s in enumerate(reads)], "group_key long, read_id long, seq string")


def write_vertices(vertices: DataFrame, path: str) -> None:
    vertices.write.parquet(path)


def write_kinds(vertices: DataFrame, path: str) -> None:
    """One folder for each kind, so that a reader of chains opens no branches."""
    vertices.write.partitionBy("kind").parquet(path)


def write_contigs(contigs: DataFrame, path: str, one_file: bool = False) -> None:
    """Sequences as text, one a line, in order of group and contig. one_file is for results that one task can write."""
    lines = contigs.filter("seq IS NOT NULL").orderBy("group_key", "contig_id").select("seq")
    (lines.coalesce(1) if one_file else lines).write.text(path)
