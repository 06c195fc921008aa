"""Storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of one file of a table of short rows.
SHORT_ROWS = 100_000
#: Bytes of a page of a table that is stored with a level of its own.
LARGE_PAGE = 4 << 20
#: Paths of the tables that this session has stored and not released.
_held: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one of this machine where that is unset and the master is local."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strandwork-{tag}-{uuid.uuid4().hex}"
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, tag: str, rows: int | None = None, codec: str | None = None, level: int | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: it cuts the lineage and outlives executors.

    rows, an estimate, is for tables of short rows: these are dealt out to files of some SHORT_ROWS rows, however many
    tasks have made them, as every file costs its task several calls of the file system. codec is Parquet's, else the session's.
    level is that of zstd, for columns that are packed already: it takes pages of LARGE_PAGE bytes, in which repeats are found from far.
    """
    path = fresh_path(df.sparkSession, tag)
    writer = (df if rows is None else df.repartition(rows // SHORT_ROWS + 2)).write
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", LARGE_PAGE)
    writer.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Deletes those of the paths that are still held."""
    held = _held.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in held:
            held.remove(path)
            _delete(spark, path)


@contextmanager
def recorded(spark: SparkSession) -> Iterator[list[str]]:
    """A list that at the end names what was stored inside and is still held."""
    held = _held.setdefault(spark.sparkContext.applicationId, [])
    before, paths = set(held), []
    try:
        yield paths
    finally:
        paths += [x for x in held if x not in before]


def release(df: DataFrame) -> None:
    """Deletes what `stored` wrote for the frame, once nothing that is still to be read comes from it."""
    drop_paths(df.sparkSession, [path] if (path := getattr(df, "stored_path", None)) else [])


def clear(spark: SparkSession) -> int:
    """Deletes all that this application has stored and not released; how many tables and folders that were."""
    paths = _held.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
