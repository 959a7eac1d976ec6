"""Session helpers: reading the input tables, the shared folder, sizes that depend on the cluster."""

from __future__ import annotations

import itertools
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema, **options) -> DataFrame:
    """An input table as a stream of its files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).options(**options)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # the source wants a folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent on a single machine (as in tests) a temporary folder is made and set;
    on a cluster its absence is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, unique over sessions."""
    return f"{shared_dir(spark)}/tidemark/{label}-{int(time.time())}-{os.getpid()}-{next(_serial)}-{uuid.uuid4().hex[:8]}"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_file(spark: SparkSession, path: str, data: bytes) -> bool:
    """A small file that appears whole under its name or not at all; false if the name is taken already.

    Goes through the manager Structured Streaming commits with, so it is atomic wherever streams are.
    """
    _, at = file_system(spark, path)
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.checkpointing.CheckpointFileManager$")
    files = kind.getField("MODULE$").get(None).create(at, spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    if files.exists(at):
        return False
    out = files.createAtomic(at, False)
    out.write(bytearray(data))
    try:
        out.close()
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read_file(spark: SparkSession, path: str) -> bytes:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible entries of a folder, sorted; none if there is no such folder."""
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    return sorted(n for s in fs.listStatus(at) if not (n := s.getPath().getName()).startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what operators have written to the shared folder; for when all results have been consumed.

    Tables and feeds that were given no path of their own lie there too.
    """
    remove(spark, f"{shared_dir(spark)}/tidemark")


def checkpoint(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage through a table written to the shared folder; survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where the scan itself has fewer parts than there are cores.

    That is so only for inputs below cores times maxPartitionBytes, which bounds what is shuffled; larger
    scans stay as they are. For row-wise work that is heavy on the CPU.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
