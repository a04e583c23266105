"""Session helpers shared by every layer: table access, shared storage, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was written, counted and found to have at most this many rows and bytes of text.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a directory of files) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session that names none gets a folder of this machine, recorded in the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lakelens.shared.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "lakelens-shared-" + uuid.uuid4().hex[:8])
        spark.conf.set("lakelens.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors.

    ``clean`` deletes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakelens/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.conf.get("spark.app.id", ""), []).append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that ``written`` made in this session, once no result that reads them is needed; their number."""
    paths = _written.pop(spark.conf.get("spark.app.id", ""), [])
    for p in paths:
        delete(spark, p)
    return len(paths)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as its object): local, remote and object stores alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def files_under(spark: SparkSession, root: str, recursive: bool = True) -> list[str]:
    """The paths of all files under a folder of any file system."""
    fs, at = file_system(spark, root)
    found, listing = [], fs.listFiles(at, recursive)
    while listing.hasNext():
        found.append(listing.next().getPath().toString())
    return sorted(found)


def read_text(spark: SparkSession, path: str, size: int | None = None) -> str | None:
    """The text of a small file, or its first bytes; null if there is none."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size if size is not None and size < fs.getFileStatus(at).getLen() else int(fs.getFileStatus(at).getLen()))
    finally:
        stream.close()
    return bytes(data).decode("utf-8", "replace")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def small_side(df: DataFrame, label: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once; broadcast when its counted rows and their bytes as text are within the bounds, else left to a shuffle join."""
    kept = written(df, label)
    if kept.count() > rows:
        return kept
    least = kept.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(kept) if least <= size else kept


def bytes_of(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, least_bytes: int = 1 << 20) -> DataFrame:
    """``df`` over all cores: for CPU-bound stages over an input of fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if bytes_of(df) < least_bytes:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
